"""The trace as a table that grows: appended batch by batch to chains that go on, refused where one is broken, and read back by document.

An event has log, seq, ts, tipo, file_id, datos (canonical JSON), hash_prev and
hash. A batch is a folder of the table, so that a batch that runs again
replaces itself; what it goes on from are the heads of the batches before it.
Within a log each hash needs the one before, so a log's new events are folded
in one task, as a stream (audit.linked); checking needs an event and its
neighbour alone, which meet by their numbers: no log is gathered.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators.audit import GENESIS, linked

EVENT = "log string, seq long, ts string, tipo string, file_id string, datos string, hash_prev string, hash string"
READING, DECISION = "lectura", "decision"  # fixed values: kinds of events that lineage reads


class BrokenTrace(ValueError):
    """The trace that was to go on is broken."""


def _json(name: str) -> Column:
    """A string column as JSON."""
    text = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, 6, 1 << 30).substr(F.lit(1), F.length(text) - 6)


def parts() -> tuple[Column, Column]:
    """What is hashed of an event, before and after the value of hash_prev: canonical JSON with sorted keys."""
    head = F.concat(F.lit('{"datos":'), F.coalesce("datos", F.lit("null")), F.lit(',"file_id":'), _json("file_id"), F.lit(',"hash_prev":"'))
    tail = F.concat(F.lit('","seq":'), F.col("seq").cast("string"), F.lit(',"tipo":'), _json("tipo"), F.lit(',"ts":'), _json("ts"), F.lit("}"))
    return head, tail


def line() -> Column:
    """An event as it is written in a log file."""
    head, tail = parts()
    return F.concat(F.regexp_replace(head, r',"hash_prev":"$', ""), F.lit(',"hash":"'), "hash", F.lit('","hash_prev":"'), "hash_prev", tail)


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The events of the table at path, of batches before the given one (all, if none is given); empty where there is no table yet."""
    try:
        rows = spark.read.schema(f"{EVENT}, batch int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"{EVENT}, batch int")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def defects(trace: DataFrame) -> DataFrame:
    """log, seq and problem of events that are broken: hash_roto (its own hash), cadena_rota (not the hash of the event before), seq_discontinuo (no event before it, or another of the same number)."""
    head, tail = parts()
    one = trace.select("log", "seq", "hash", "hash_prev", (F.sha2(F.concat(head, "hash_prev", tail), 256) != F.col("hash")).alias("bad"))
    last = trace.groupBy("log", "seq").agg(F.max("hash").alias("before"), F.count("*").alias("n")).select("log", (F.col("seq") + 1).alias("seq"), "before", "n")
    own = trace.groupBy("log", "seq").agg(F.count("*").alias("same"))
    met = one.join(last, ["log", "seq"], "left").join(own, ["log", "seq"])
    before = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("before"))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce("bad", F.lit(True)), "hash_roto"),
            F.when(before.isNotNull() & ~before.eqNullSafe(F.col("hash_prev")), "cadena_rota"),
            F.when(before.isNull() | (F.col("same") > 1), "seq_discontinuo"),
        )
    )
    return met.select("log", "seq", F.explode(found).alias("problem"))


def append(events: DataFrame, path: str, batch: int, order: str = "num") -> None:
    """Chains events (log, ts, tipo, file_id, datos and what orders them within a log) to what the table at path holds of earlier batches, and writes them as this batch.

    Logs that go on are checked first: BrokenTrace if one has a defect, and nothing is written. Run again, a batch writes the same; so does a run that was stopped.
    """
    spark = events.sparkSession
    old = read(spark, path, batch).join(events.select("log").distinct(), "log", "left_semi")
    if broken := defects(old).orderBy("log", "seq").first():
        raise BrokenTrace(f"log {broken['log']} can't go on: {broken['problem']} at event {broken['seq']}")
    heads = old.groupBy("log").agg(F.max_by("hash", "seq").alias("_from"), F.max("seq").alias("_last"))
    head, tail = parts()
    place = F.expr(f"row_number() over (partition by log order by {order})")
    rows = events.withColumn("_n", place).join(heads, "log", "left").withColumn("seq", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long"))
    rows = rows.select("log", "seq", "ts", "tipo", "file_id", "datos", head.alias("_head"), tail.alias("_tail"), F.when(F.col("_n") == 1, F.coalesce("_from", F.lit(GENESIS))).alias("_from"))
    linked(rows.repartition("log"), "log").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def sink(path: str, order: str = "num"):
    """For writeStream.foreachBatch: every micro-batch goes on from the ones before."""
    return lambda events, batch: append(events, path, batch, order)


def pending(files: DataFrame, trace: DataFrame) -> DataFrame:
    """Of files (file_id), those without a decision in the trace: what a run that goes on still has to do."""
    return files.join(trace.where(F.col("tipo") == DECISION).select("file_id"), "file_id", "left_anti")


_SAID = "struct<result: string, version_norma: string, motivos: array<string>, hechos: array<struct<ok: boolean, nombre: string, regla: string, motivo: string>>>"


def lineage(trace: DataFrame, order: tuple[str, ...] = ("log", "seq")) -> DataFrame:
    """By document: resultado, motivos, version_norma and por_que (failing facts, then reasons) of its last decision, the sha256 of its last reading, and how many events it has. A document's events aren't gathered: the last of each kind is kept."""
    place = F.struct(*order)
    last = lambda kind: F.max_by("datos", F.when(F.col("tipo") == kind, place))
    rows = trace.where("file_id is not null and file_id <> ''").groupBy("file_id").agg(last(DECISION).alias("d"), last(READING).alias("r"), F.count("*").alias("n_events"))
    rows = rows.withColumn("d", F.from_json("d", _SAID)).withColumn("sha256", F.get_json_object("r", "$.sha256"))
    failing = F.expr("transform(filter(coalesce(d.hechos, array()), h -> not coalesce(h.ok, false)), h -> concat(coalesce(nullif(h.nombre, ''), nullif(h.regla, ''), '?'), ': ', coalesce(h.motivo, 'sin motivo declarado')))")
    reasons = F.coalesce("d.motivos", F.array().cast("array<string>"))
    return rows.select("file_id", F.col("d.result").alias("resultado"), reasons.alias("motivos"), F.col("d.version_norma").alias("version_norma"), "sha256", F.concat(failing, reasons).alias("por_que"), "n_events")
