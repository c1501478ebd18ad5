"""Files of JSON lines as tables: each line with its file and number, traces of several lots as one, the sidecar of the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.operators.traces import said

DECISION = "decision"
# What a decision's record holds.
RECORD = (
    "file_id string, result string, motivos array<string>, hechos array<struct<regla:string,nombre:string,ok:boolean,duro:boolean,informativo:boolean,motivo:string>>, campos map<string,string>, lote string, metodo_lectura string, escalon_lectura string, calidad_lectura string, segundos_lectura string, "
    "identificacion_fiable boolean, version_norma string, sha256 string, nota_documento string, sospechosos array<string>, sospechosos_meta array<string>, segunda_lectura string"
)


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """path, num (from 1, in the file) and value of every line (ended by \\n) of the files under path; with across, num goes on from file to file, in the order of their names.

    Files may be split: a line's number is its place in its split after the lines of the splits before. That needs no order between tasks, and holds however often one runs.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    before = Window.partitionBy(*[] if across else ["path"]).orderBy("path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("path", "_split").count().select("path", "_split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("path", "_split").orderBy("_at"))
    return rows.withColumn("_n", inside).join(starts, ["path", "_split"]).select("path", (F.col("_start") + F.col("_n")).alias("num"), "value")


def is_json(text: Column) -> Column:
    """Whether text is one JSON value and nothing else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & (F.trim(text) != ""), F.lit(False))


def is_object(text: Column) -> Column:
    """Whether text is one JSON object and nothing else."""
    return is_json(text) & F.coalesce(F.regexp_replace(text, r"^\s+", "").startswith("{"), F.lit(False))


def _has(text: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def queue_notes(spark: SparkSession, path: str) -> DataFrame:
    """file_id and segunda_lectura (JSON) of the review queue's sidecar: a file's last note counts; lines that can't be read, or have no note, are passed over."""
    rows = numbered_lines(spark, path).where(is_object(F.col("value"))).select("path", "num", said(F.get_json_object("value", "$.file_id")).alias("file_id"), F.get_json_object("value", "$.segunda_lectura").alias("segunda_lectura"))
    return rows.where(F.col("file_id").isNotNull() & F.col("segunda_lectura").startswith("{")).groupBy("file_id").agg(F.max_by("segunda_lectura", F.struct("path", "num")).alias("segunda_lectura"))


def trace_records(spark: SparkSession, sources: list[str], queue: DataFrame | None = None) -> DataFrame:
    """Decisions of traces, flat or chained, as one table: src (the place in sources), path, num, problem, first, and RECORD's columns.

    Lines are ordered by source, file name and number; `first` marks the one that stands for its file_id. problem tells a line that can't be used (`ilegible`: no JSON object, `sin_file_id`), which has no record; blank lines and a chain's other events are left out. queue (file_id, segunda_lectura) replaces a record's own note.
    """
    c = F.col
    lines = [numbered_lines(spark, path).withColumn("src", F.lit(i)) for i, path in enumerate(sources)]
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    every = every.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).where("value <> ''")
    good = is_object(c("value"))
    rows = every.select("src", "path", "num", "value", good.alias("_good"), (good & _has(c("value"), "tipo")).alias("_event"))
    data = F.when(c("_event"), F.get_json_object("value", "$.datos")).otherwise(c("value"))
    mine = ~c("_event") | ((F.get_json_object("value", "$.tipo") == DECISION) & data.startswith("{"))
    rows = rows.where(~c("_good") | mine).withColumn("_r", F.from_json(F.when(c("_good"), data), RECORD))
    file_id = F.coalesce(said(F.get_json_object("value", "$.file_id")), F.when(c("_event"), said(c("_r.file_id"))))
    rows = rows.withColumn("file_id", F.when(c("_good"), file_id))
    problem = F.when(~c("_good"), "ilegible").when(c("file_id").isNull(), "sin_file_id")
    fields = [f for f in rows.select("_r.*").columns if f != "file_id"]
    out = rows.select("src", "path", "num", problem.alias("problem"), "file_id", *[F.when(problem.isNull(), c(f"_r.{f}")).alias(f) for f in fields])
    place = F.struct("src", "path", "num")
    heads = out.where("file_id is not null").groupBy("file_id").agg(F.min(place).alias("_head"))
    # Lines without an id get keys of their own there.
    key = F.coalesce("file_id", F.concat_ws("\x00", F.lit(""), "path", c("num").cast("string")))
    out = out.withColumn("_key", key).join(heads.withColumnRenamed("file_id", "_key"), "_key", "left").withColumn("first", F.coalesce(c("_head") == place, F.lit(False))).drop("_head")
    if queue is not None:
        notes = queue.select(c("file_id").alias("_key"), c("segunda_lectura").alias("_note"))
        out = out.join(notes, "_key", "left").withColumn("segunda_lectura", F.coalesce("_note", "segunda_lectura")).drop("_note")
    return out.select("src", "path", "num", "problem", "first", "file_id", *fields)
