"""The hash-chained log: building, sealing and verifying it.

A chain needs each hash before the next, so its order is inherent; runs have
chains of their own, and runs are what is parallel. Verifying needs only each
event's neighbour and is parallel throughout.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, text as it is, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str)


def canonical_json(column: Column) -> Column:
    """JSON text in canonical form; null where it can't be read."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return canonical(json.loads(x))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(column)


def hmac_sha256(column: Column, key: str) -> Column:
    """HMAC by its definition: two nested hashes, with the key padded to a block."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, column.cast("binary")), 256))), 256)


def payload(*columns: str, seq: str = "seq") -> tuple[Column, Column]:
    """What of an event is hashed: its canonical JSON (sorted keys, no spaces, nulls written) in two parts, before and after the value of hash_prev. Columns that hold numbers or text."""
    names = sorted([*columns, seq])
    write = lambda some: F.to_json(F.struct(*some), {"ignoreNullFields": "false"})
    before, after = [n for n in names if n < "hash_prev"], [n for n in names if n > "hash_prev"]
    head = F.concat(F.regexp_replace(write(before), r"\}$", ","), F.lit('"hash_prev":"')) if before else F.lit('{"hash_prev":"')
    tail = F.concat(F.lit('",'), F.substr(write(after), F.lit(2))) if after else F.lit('"}')
    return head, tail


def chained(events: DataFrame, run: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """events of each run in order with seq (from 0), hash_prev and hash: the fold of sha256 over canonical events.

    Runs are sorted by Spark and folded as a stream, in linear time; no run is gathered. Within a run the order of a chain is inherent.
    """
    rows = events.withColumn("seq", (F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1).cast("long"))
    head, tail = payload(*columns)
    return linked(rows.withColumn("_head", head).withColumn("_tail", tail).withColumn("_from", F.when(F.col("seq") == 0, F.lit(GENESIS))), run)


def linked(rows: DataFrame, run: str) -> DataFrame:
    """rows with hash_prev and hash. rows: seq, _head and _tail (what is hashed around hash_prev), and _from: at the first row of a run, the hash that it follows. All rows of a run are in one partition."""
    rows = rows.sortWithinPartitions(run, "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = GENESIS
        for b in batches:
            prev, own = [], []
            heads, tails, begins = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("_head", "_tail", "_from"))
            for h, t, begin in zip(heads, tails, begins, strict=True):
                last = begin or last
                prev.append(last)
                last = hashlib.sha256(f"{h}{last}{t}".encode()).hexdigest()
                own.append(last)
            kept = [i for i, n in enumerate(b.schema.names) if n not in ("_head", "_tail", "_from")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*(b.schema.names[i] for i in kept), "hash_prev", "hash"])

    schema = rows.drop("_head", "_tail", "_from").withColumn("hash_prev", F.lit("")).withColumn("hash", F.lit("")).schema
    return rows.mapInArrow(fold, schema)


def verified(chain: DataFrame, run: str, columns: tuple[str, ...], seals: DataFrame | None = None) -> DataFrame:
    """run, seq and problem of every event that is broken: hash_roto (its own hash), cadena_rota (the one before), seq_discontinuo; with seals (run, seal) also sello_distinto of runs whose head is another (at their last seq)."""
    w = Window.partitionBy(run).orderBy("seq")
    before, last = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)), F.coalesce(F.lag("seq").over(w), F.lit(-1))
    head, tail = payload(*columns)
    found = F.array_compact(
        F.array(
            F.when(F.sha2(F.concat(head, "hash_prev", tail), 256) != F.col("hash"), "hash_roto"),
            F.when(before != F.col("hash_prev"), "cadena_rota"),
            F.when(last + 1 != F.col("seq"), "seq_discontinuo"),
        )
    )
    out = chain.select(run, "seq", found.alias("_found")).select(run, "seq", F.explode("_found").alias("problem"))
    if seals is not None:
        heads = chain.groupBy(run).agg(F.max_by("hash", "seq").alias("_head"), F.max("seq").alias("seq"))
        out = out.unionByName(heads.join(seals, run).where("_head <> seal").select(run, "seq", F.lit("sello_distinto").alias("problem")))
    return out


FIELDS = ("seq", "ts", "tipo", "file_id", "datos", "hash_prev", "hash")  # fixed values: an event's fields
_LINE = "kind string, seq long, hash string, hash_prev string, good string, canonical boolean"


#: Lines of a log that one task looks at in their order.
RANGE_LINES = 10_000


def _line(text: str) -> tuple:
    if not text.strip():
        return "linea_vacia", None, None, None, None, None
    try:
        event = json.loads(text)
    except ValueError:
        return "json_invalido", None, None, None, None, None
    if not isinstance(event, dict) or any(f not in event for f in FIELDS):
        return "evento_invalido", None, None, None, None, None
    good = hashlib.sha256(canonical({k: event[k] for k in FIELDS if k != "hash"}).encode()).hexdigest()
    seq = event["seq"] if type(event["seq"]) is int else None
    texts = (event[k] if isinstance(event[k], str) else None for k in ("hash", "hash_prev"))
    return "evento", seq, *texts, good, text == canonical(event)


def verified_lines(lines: DataFrame, log: str = "log", number: str = "num", text: str = "line", seals: DataFrame | None = None) -> DataFrame:
    """log, num and problem of every defect of logs as written, one event a line: linea_vacia, json_invalido, evento_invalido, hash_roto, cadena_rota (not after a line that can't be read), seq_discontinuo (lines lost count), formato_no_canonico, sello_distinto (seals: log, seal).

    Lines are read one by one; what an event follows comes from windows over RANGE_LINES lines and from what the ranges of its log carry on.
    """

    @F.pandas_udf(_LINE)
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_line(x or "") for x in s], columns=["kind", "seq", "hash", "hash_prev", "good", "canonical"]).astype({"seq": "Int64"})

    c = F.col
    rows = lines.select(c(log).alias("log"), c(number).alias("num"), read(c(text)).alias("e")).select("log", "num", "e.*")
    event, lost = c("kind") == "evento", c("kind").isin("json_invalido", "evento_invalido")
    # What an event follows is found within its range of lines, and else carried over from the ranges before.
    rows = rows.withColumn("range", F.floor(c("num") / RANGE_LINES))
    inside = Window.partitionBy("log", "range").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lost", F.coalesce(F.sum(lost.cast("long")).over(inside), F.lit(0)))
    last = lambda column, over: F.last(F.when(event, column), ignorenulls=True).over(over)
    rows = rows.withColumns({"p_lost": last(c("lost"), inside), "p_hash": last(c("hash"), inside), "p_seq": last(c("seq"), inside)})
    held = lambda column: F.max_by(column, F.when(event & column.isNotNull(), c("num")))
    ends = rows.groupBy("log", "range").agg(F.sum(lost.cast("long")).alias("e_sum"), held(c("lost")).alias("e_lost"), held(c("hash")).alias("e_hash"), held(c("seq")).alias("e_seq"))
    before = Window.partitionBy("log").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("r_sum", F.coalesce(F.sum("e_sum").over(before), F.lit(0)))
    carried = {"r_hash": F.last("e_hash", ignorenulls=True).over(before), "r_seq": F.last("e_seq", ignorenulls=True).over(before), "r_lost": F.last(c("r_sum") + c("e_lost"), ignorenulls=True).over(before)}
    rows = rows.join(ends.withColumns(carried).select("log", "range", "r_sum", *carried), ["log", "range"])
    gap = c("r_sum") + c("lost") - F.coalesce(c("r_sum") + c("p_lost"), c("r_lost"), F.lit(0))
    prev = F.coalesce("p_hash", "r_hash", F.lit(GENESIS))
    expected = F.coalesce("p_seq", "r_seq", F.lit(-1)) + 1 + gap
    found = F.when(~event, F.array("kind")).otherwise(
        F.array(
            F.when(~c("good").eqNullSafe(c("hash")), "hash_roto"),
            F.when((gap == 0) & ~c("hash_prev").eqNullSafe(prev), "cadena_rota"),
            F.when(~c("seq").eqNullSafe(expected), "seq_discontinuo"),
            F.when(~c("canonical"), "formato_no_canonico"),
        )
    )
    out = rows.select("log", "num", F.array_compact(found).alias("_found")).select("log", "num", F.explode("_found").alias("problem"))
    if seals is not None:
        heads = rows.groupBy("log").agg(F.coalesce(F.max_by("hash", F.when(event & c("hash").isNotNull(), c("num"))), F.lit(GENESIS)).alias("head"), F.max("num").alias("num"))
        out = out.unionByName(heads.join(seals, "log").where("head <> seal").select("log", "num", F.lit("sello_distinto").alias("problem")))
    return out


def verified_files(files: DataFrame, expected: DataFrame | None = None, seals: DataFrame | None = None) -> DataFrame:
    """log, num and problem of every defect of log files (path, content as bytes; log is the path): those of verified_lines, and no_existe (expected: path), ilegible (no UTF-8) and truncado (no line break at the end; num is the last line, which is read all the same). seals: log, seal."""
    c = F.col
    text = F.when(F.is_valid_utf8(c("content").cast("string")), c("content").cast("string"))
    rows = files.select(c("path").alias("log"), text.alias("text"), F.split(text, "\n").alias("lines"))
    cut = (c("text") != "") & ~F.endswith("text", F.lit("\n"))
    whole = F.when(c("text").isNull(), F.struct(F.lit(0).alias("num"), F.lit("ilegible").alias("problem"))).when(cut, F.struct(F.size("lines").alias("num"), F.lit("truncado").alias("problem")))
    out = rows.select("log", whole.alias("p")).where("p is not null").select("log", "p.num", "p.problem")
    lines = rows.select("log", F.posexplode(F.expr("if(text = '', array(), if(endswith(text, '\n'), slice(lines, 1, size(lines) - 1), lines))")).alias("num", "line"))
    out = out.unionByName(verified_lines(lines.withColumn("num", c("num") + 1), seals=seals))
    if expected is not None:
        out = out.unionByName(expected.select(c("path").alias("log")).join(files.select(c("path").alias("log")), "log", "left_anti").select("log", F.lit(0).alias("num"), F.lit("no_existe").alias("problem")))
    return out


def seal(chain: DataFrame, run: str) -> DataFrame:
    """The head hash of each run and its number of events."""
    return chain.groupBy(run).agg(F.max_by("hash", "seq").alias("seal"), F.count("*").alias("n_events"))
