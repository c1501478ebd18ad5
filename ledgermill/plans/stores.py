"""Registered queries of the stores: snapshots that replace one another, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import store
from ledgermill.plans.catalog import _t, query
from ledgermill.plans.world import SQL as WORLD
from ledgermill.plans.world import World
from ledgermill.sources.scratch import shared

_STORE = "id string, importe double, estado string, clave string, snapshot_id string, vigente boolean"


def _snapshots(spark, sf_dir) -> DataFrame:
    """Three snapshots of the ledger put in one after the other, the last of them twice, each state written and read again."""
    led = World(spark, sf_dir).ledger.select(F.col("asiento_id").alias("id"), F.col("importe").cast("double").alias("importe"), "estado", F.concat_ws("|", "pedido", "asiento_id").alias("clave"), "seq")
    first = led.where("seq % 5 <> 0")
    second = led.where("seq % 5 <> 1").withColumn("importe", F.col("importe") + 1)
    third = led.where("seq % 5 <> 2").withColumn("estado", F.when(F.col("seq") % 2 == 0, "PAGADA").otherwise(F.col("estado")))
    root = shared(spark, "store")
    for name, rows in (("s1", first), ("s2", second), ("s3", third), ("s3", third)):
        store.switch(store.with_snapshot(store.current(spark, root, _STORE), rows.drop("seq"), name), root)
    return store.current(spark, root, _STORE)


@query(WORLD + "SELECT asiento_id AS id, CAST(importe AS DOUBLE) + CASE WHEN seq % 5 = 2 THEN 1 ELSE 0 END AS importe, CASE WHEN seq % 5 <> 2 AND seq % 2 = 0 THEN 'PAGADA' ELSE estado END AS estado, pedido || '|' || asiento_id AS clave, CASE WHEN seq % 5 = 2 THEN 's2' ELSE 's3' END AS snapshot_id, seq % 5 <> 2 AS vigente FROM ledger")
def snapshot_store(spark, sf_dir):
    return _snapshots(spark, sf_dir)


@query(WORLD + "SELECT count(*) FILTER (seq % 5 <> 2) AS n_snapshot, count(*) FILTER (seq % 5 <> 2) AS n_vigentes, count(DISTINCT asiento_id) FILTER (seq % 5 <> 2) AS n_claves, true AS ok FROM ledger")
def snapshot_checks(spark, sf_dir):
    expected = World(spark, sf_dir).ledger.where("seq % 5 <> 2").count()
    return store.snapshot_problems(_snapshots(spark, sf_dir), "s3", expected, "clave")


# Documents under names that come again, in two batches.
_UPLOADS = """WITH d AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN source || '.pdf' ELSE 'doc_' || doc_id % 1009 || '.pdf' END AS file_id, sha256(coalesce(CASE WHEN doc_id % 7 = 0 THEN source ELSE text END, '')) AS sha256 FROM documents),
f AS (SELECT *, first_value(seq) OVER w AS f1, first_value(sha256) OVER w AS s1 FROM d WINDOW w AS (PARTITION BY file_id ORDER BY seq % 2, seq)) """


@query(_UPLOADS + "SELECT seq, file_id, sha256, CASE WHEN seq = f1 THEN 'nuevo' WHEN sha256 = s1 THEN 'duplicado' ELSE 'conflicto' END AS clase FROM f")
def upload_classes(spark, sf_dir):
    c = F.col
    d = _t(spark, sf_dir, "documents").select(
        c("doc_id").alias("seq"),
        F.when(c("doc_id") % 3 == 0, F.concat("source", F.lit(".pdf"))).otherwise(F.concat(F.lit("doc_"), (c("doc_id") % 1009).cast("string"), F.lit(".pdf"))).alias("file_id"),
        F.sha2(F.coalesce(F.when(c("doc_id") % 7 == 0, c("source")).otherwise(c("text")), F.lit("")), 256).alias("sha256"),
    )
    empty = spark.createDataFrame([], "file_id string, sha256 string")
    one = store.uploads(empty, d.where("seq % 2 = 0"))
    two = store.uploads(store.accepted(empty, one), d.where("seq % 2 = 1"))
    return one.unionByName(two)
