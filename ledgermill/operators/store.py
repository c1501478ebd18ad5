"""A store of ledger snapshots and one of uploaded documents: what came again, what contradicts, what is retired, and a switch from one state to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW, AGAIN, CONFLICT = "nuevo", "duplicado", "conflicto"


def with_snapshot(store: DataFrame, entries: DataFrame, snapshot: str) -> DataFrame:
    """The store once a snapshot is in it: entries replace those of their id, and entries of all other snapshots are no longer `vigente`. The same snapshot once more changes nothing.

    store: id, snapshot_id, vigente and others. entries: id and the others; ids are unique in both.
    """
    others = [c for c in store.columns if c not in ("id", "snapshot_id", "vigente")]
    now = entries.select("id", *others, F.lit(snapshot).alias("snapshot_id"), F.lit(True).alias("vigente"), F.lit(1).alias("_at"))
    old = store.withColumns({"vigente": F.col("vigente") & (F.col("snapshot_id") == snapshot), "_at": F.lit(0)})
    rest = [c for c in store.columns if c != "id"]
    both = old.unionByName(now).groupBy("id").agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
    return both.select("id", "_row.*").select(*store.columns)


def snapshot_problems(store: DataFrame, snapshot: str, expected: int, key: str) -> DataFrame:
    """One row: what the store holds of the snapshot, what is in force, how many keys that has, and whether each is as expected."""
    c = F.col
    out = store.agg(F.count_if(c("snapshot_id") == snapshot).alias("n_snapshot"), F.count_if("vigente").alias("n_vigentes"), F.count_distinct(F.when(c("vigente"), c(key))).alias("n_claves"))
    return out.withColumn("ok", (c("n_snapshot") == expected) & (c("n_vigentes") == expected) & (c("n_claves") == expected))


def uploads(store: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (file_id, sha256, seq and others) with `clase`: `nuevo`, `duplicado` (its name is there with the same content) or `conflicto` (with other content).

    Against what the store has (file_id, sha256), or else the batch's first document of that name, which is the new one. Documents of one name meet their first by a join; names are grouped before, so a name that comes very often costs one row there.
    """
    c = F.col
    seen = store.groupBy("file_id").agg(F.min("sha256").alias("_theirs"))
    heads = batch.groupBy("file_id").agg(F.min(F.struct("seq", "sha256")).alias("_head"))
    known = heads.join(seen, "file_id", "left").select("file_id", F.coalesce("_theirs", "_head.sha256").alias("_sha"), F.when(c("_theirs").isNull(), c("_head.seq")).alias("_first"))
    rows = batch.join(known, "file_id")
    kind = F.when(c("seq") == c("_first"), NEW).when(c("sha256") == c("_sha"), AGAIN).otherwise(CONFLICT)
    return rows.select(*batch.columns, kind.alias("clase"))


def accepted(store: DataFrame, classes: DataFrame) -> DataFrame:
    """The store with the new documents of a batch; duplicates are in it already, conflicts are refused."""
    return store.unionByName(classes.where(F.col("clase") == NEW).select(*store.columns))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole states under root, in order. A state is whole once its job has put the mark of success there."""
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
    done = [p for p in found if fs.exists(_fs(spark, f"{p.toString()}/_SUCCESS")[0])]
    return sorted(int(p.getName()[2:]) for p in done)


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last whole state of the store, empty before the first."""
    known = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def switch(store: DataFrame, root: str) -> int:
    """Writes the store as its next state. Readers go on with the last whole one; a state that a lost job left half written is written over."""
    spark = store.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    store.write.mode("overwrite").parquet(f"{root}/v={number}")
    return number
