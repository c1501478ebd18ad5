"""Registered queries of workbooks: cells of a workbook a nation, made from the suppliers, with columns under other names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.plans.catalog import _t, query
from ledgermill.sources import workbook


def _cells(spark, sf_dir) -> DataFrame:
    """Suppliers of a nation on rows of their numbers; every fourth stands there again, half of them with another account. A sheet that doesn't count holds all of them once more."""
    c, lit = F.col, F.lit
    s = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), c("s_nationkey").alias("n"), c("s_name").alias("name"))
    k = c("k")
    path = F.concat(lit("wb"), c("n").cast("string"))
    again = F.explode(F.when(k % 4 == 0, F.array(lit(0), lit(1))).otherwise(F.array(lit(0)))).alias("again")
    rows = s.select("*", again)
    iban = F.concat(lit("ES"), F.lpad((k + F.when((c("again") == 1) & (k % 8 == 0), 1).otherwise(0)).cast("string"), 22, "0"))
    values = [F.concat(lit(" p"), k.cast("string")), c("name"), iban]
    sheets = F.array(lit(workbook.SUPPLIERS), lit("NO_TOCAR"))
    body = rows.select(path.alias("path"), F.explode(sheets).alias("sheet"), (k * 2 + c("again") + 2).cast("long").alias("row"), F.posexplode(F.array(*values)).alias("col", "value"))
    heads = s.select(path.alias("path"), c("n")).distinct().select("path", F.explode(sheets).alias("sheet"), lit(1).cast("long").alias("row"), F.posexplode(F.array(F.when(c("n") % 2 == 0, "Proveedor_ID").otherwise("  I.D. "), lit("Razón social"), lit("IBAN "))).alias("col", "value"))
    # A head with an accent isn't among the names; where the nation is odd it is written without.
    heads = heads.withColumn("value", F.when(c("value").startswith("Raz") & (F.substr("path", lit(3)).cast("int") % 2 == 1), "RAZON SOCIAL").otherwise(c("value")))
    return body.unionByName(heads).withColumn("col", c("col") + 1)


_BOOKS = """WITH s AS (SELECT s_suppkey AS k, 'wb' || s_nationkey AS path, 'P' || s_suppkey AS id, CASE WHEN s_nationkey % 2 = 1 THEN trim(s_name) ELSE '' END AS razon_social, 'ES' || lpad(CAST(s_suppkey AS VARCHAR), 22, '0') AS iban FROM supplier) """


@query(_BOOKS + "SELECT path, id, razon_social, '' AS nif, iban, '' AS ciudad, '' AS condiciones FROM s")
def workbook_suppliers(spark, sf_dir):
    return workbook.suppliers(_cells(spark, sf_dir))[0]


@query(_BOOKS + "SELECT path, id, CAST(k * 2 + 3 AS BIGINT) AS row, CASE WHEN k % 8 = 0 THEN 'ES' || lpad(CAST(k + 1 AS VARCHAR), 22, '0') ELSE iban END AS iban, iban AS first_iban, k % 8 <> 0 AS igual FROM s WHERE k % 4 = 0")
def workbook_repeats(spark, sf_dir):
    return workbook.suppliers(_cells(spark, sf_dir))[1]
