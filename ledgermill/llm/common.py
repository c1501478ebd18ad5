"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it is known to have at most so many rows.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or (local runs without one) a temporary folder set here."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgermill-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the cluster's own cleaning removes the folder
        pass


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended: its catalog is gone, or keeps an entry without files
        pass


def stored(df: DataFrame, *then: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read again: its lineage is cut, so that lost executors cost no recomputation.

    then: stored tables that nothing needs once df is written; they go at once, all others at the session's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgermill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    for old in then:
        for place in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            if "/ledgermill-" in place:
                _remove(spark, place)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """df, shuffled by its keys once and stored as a table of so many buckets: joins by the keys need no further shuffle of it. Lineage is cut as by stored."""
    spark = df.sparkSession
    name = f"ledgermill_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/ledgermill-{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    atexit.register(_remove, spark, path)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `rows` rows; else df as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that joins shuffle both sides. Spark takes what an explode makes, and what compressed files hold, for far smaller than it is, and would broadcast it."""
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has columns of these names (in any case)."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"{name}_"
        there.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
