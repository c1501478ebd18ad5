"""Readers and writers of the reconciliation's files, on Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions import normalize as N

# The columns of the ledger's exports.
LEDGER_CSV = "asiento_id string, fecha_registro string, proveedor_id string, nif string, pedido string, importe_esperado string, estado string"
LEDGER_XML = "id string, fecha string, proveedor string, nif string, pedido string, importe string, estado string"


def _ledger(df: DataFrame) -> DataFrame:
    return df.select("asiento_id", N.civil_date(F.col("fecha")).alias("fecha"), "proveedor", N.tax_id(F.col("nif")).alias("nif"), N.order_id(F.col("pedido")).alias("pedido"), N.cents(N.amount(F.col("importe"))).alias("importe"), F.upper(F.trim("estado")).alias("estado"))


def ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's export; rows whose amount can't be read are left out, unknown states stay."""
    raw = spark.read.schema(LEDGER_CSV).option("header", True).csv(path)
    return _ledger(raw.withColumnsRenamed({"fecha_registro": "fecha", "proveedor_id": "proveedor", "importe_esperado": "importe"})).where("importe is not null")


def ledger_xml(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Landed pages of the ledger's service: small files, read whole and decoded as told, whether they declare their encoding or not."""
    pages = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("page"))
    entries = F.from_xml("page", f"asientos struct<asiento:array<struct<{LEDGER_XML}>>>")["asientos"]["asiento"]
    return _ledger(pages.select(F.inline(entries)).withColumnRenamed("id", "asiento_id")).where("importe is not null")


def ledger_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A JSON snapshot: a list of entries, or an object that holds them under `asientos`."""
    entry = "asiento_id string, fecha string, proveedor string, nif string, pedido string, importe string, estado string"
    text = spark.read.option("wholetext", True).text(path)
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.asientos"), f"array<struct<{entry}>>"), F.from_json("value", f"array<struct<{entry}>>"))
    return _ledger(text.select(F.inline(rows))).where("importe is not null")


def deliverable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a deliverable (file_id, result; a file's last line counts), and its lines that can't be read. Lines are ordered by file and offset, as Spark numbers them."""
    lines = spark.read.text(path).withColumn("_k", F.monotonically_increasing_id())
    rows = lines.select("value", "_k", F.from_json("value", "file_id string, result string").alias("r"))
    bad = F.col("r.file_id").isNull() | F.col("r.result").isNull()
    good = rows.where(~bad).groupBy("r.file_id").agg(F.max_by("r.result", "_k").alias("result"))
    return good, rows.where(bad & (F.trim("value") != "")).select("value")


def write_deliverable(df: DataFrame, path: str) -> None:
    """file_id and result alone, in order of file_id, as JSON lines; refuses results outside the contract and ids that are empty or padded."""
    ok = F.col("result").isin("PAGAR", "ESCALAR", "NO_PAGAR") & (F.trim("file_id") == F.col("file_id")) & (F.col("file_id") != "")
    checked = df.select("file_id", "result").withColumn("file_id", F.when(F.coalesce(ok, F.lit(False)), F.col("file_id")).otherwise(F.raise_error(F.concat(F.lit("bad row: "), F.coalesce("file_id", F.lit("null"))))))
    checked.orderBy("file_id").write.mode("overwrite").json(path)


def reference(spark: SparkSession, path: str) -> DataFrame:
    """An outside reference {"files": {file_id: {"verdict": {"primary", "acceptable"}}}} as rows."""
    kind = "struct<files:map<string,struct<verdict:struct<primary:string,acceptable:array<string>>>>>"
    text = spark.read.option("wholetext", True).text(path)
    files = text.select(F.explode(F.from_json("value", kind)["files"]).alias("file_id", "f"))
    return files.select("file_id", F.col("f.verdict.primary").alias("result"), F.col("f.verdict.acceptable").alias("acceptable"))


def binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with their checksum; their text is read by a library of the caller's choice."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_id"), F.sha2("content", 256).alias("sha256"), "length", "content")
