"""Workbooks as tables: cells of allowed sheets, columns found by what their heads are called, suppliers, orders and lists for review."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions import normalize as N
from ledgermill.operators.match import last_per_key

# The sheets that count, and what their columns may be called.
SUPPLIERS, ORDERS, POLICY, REVIEW = "Proveedores", "Pedidos_2026", "Norma_Pagos_v3", "pendiente_revisar"
SUPPLIER_HEADS = {"id": ["id", "proveedorid"], "razon_social": ["razonsocial"], "nif": ["nif", "cif"], "iban": ["iban"], "ciudad": ["ciudad"], "condiciones": ["condiciones"]}
ORDER_HEADS = {"pedido": ["pedido"], "proveedor_id": ["proveedorid", "proveedor"], "nif": ["nif"], "importe": ["importetotal", "importe"], "estado": ["estado"], "fecha": ["fechapedido", "fecha"]}
CELLS = "path string, sheet string, row long, col int, value string"


def _cells_of(content: bytes, sheets: frozenset[str]):
    """(sheet, row, col, value) of a workbook's cells, from 1; blank ones are left out."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = lambda name: ElementTree.fromstring(z.read(name))
        shared = [text(e) for e in root("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        parts = {e.get("Id"): e.get("Target") for e in root("xl/_rels/workbook.xml.rels")}
        for s in (e for e in root("xl/workbook.xml").iter() if tag(e) == "sheet"):
            if s.get("name") not in sheets:
                continue
            part = parts[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            with z.open(part.lstrip("/") if part.startswith("/") else f"xl/{part}") as f:
                for _, e in ElementTree.iterparse(f):
                    if tag(e) != "row":
                        continue
                    for c in e:
                        letters, number = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                        col = 0
                        for x in letters:
                            col = col * 26 + ord(x) - 64
                        v = next((x.text for x in c if tag(x) == "v"), None)
                        value = text(c) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v is not None else v
                        if value:
                            yield s.get("name"), int(number), col, value
                    e.clear()


def cells(spark: SparkSession, path: str, sheets: tuple[str, ...] = (SUPPLIERS, ORDERS, POLICY, REVIEW)) -> DataFrame:
    """CELLS of the allowed sheets of the workbooks under path, a task a file; other sheets aren't read. Values are text as they are stored."""
    allowed = frozenset(sheets)

    def read(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for cell in _cells_of(content, allowed):
                    rows.append((name, *cell))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(read, CELLS)


def table(found: DataFrame, sheet: str, heads: dict[str, list[str]]) -> DataFrame:
    """path, row and a column for each of heads: the sheet's rows, by the first column whose head (small letters and digits alone) is one of its names; null where there is none."""
    rows = found.where(F.col("sheet") == sheet)
    clean = F.regexp_replace(F.lower(F.trim("value")), "[^a-z0-9]", "")
    named = rows.where("row = 1").select("path", "col", clean.alias("_head"))
    fields = [F.when(F.col("_head").isin(names), field) for field, names in heads.items()]
    places = named.select("path", "col", F.explode(F.array_compact(F.array(*fields))).alias("_field")).groupBy("path", "_field").agg(F.min("col").alias("col"))
    met = rows.where("row > 1").join(places, ["path", "col"])
    return met.groupBy("path", "row").agg(*[F.max(F.when(F.col("_field") == f, F.col("value"))).alias(f) for f in heads])


def _text(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit(""))


def suppliers(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suppliers of each workbook, by id (the first row counts), and its repeated rows: path, id, row, iban, first_iban, and whether they are `igual`."""
    rows = table(found, SUPPLIERS, SUPPLIER_HEADS).where(F.trim("id") != "").select("path", "row", F.upper(F.trim("id")).alias("id"), _text("razon_social").alias("razon_social"), F.coalesce(N.tax_id(F.col("nif")), F.lit("")).alias("nif"), F.coalesce(N.iban(F.col("iban")), F.lit("")).alias("iban"), _text("ciudad").alias("ciudad"), _text("condiciones").alias("condiciones"))
    values = F.struct("razon_social", "nif", "iban", "ciudad", "condiciones")
    firsts = rows.groupBy("path", "id").agg(F.min(F.struct("row", values.alias("v"))).alias("_first"))
    again = rows.join(firsts, ["path", "id"]).where(F.col("row") > F.col("_first.row")).select("path", "id", "row", "iban", F.col("_first.v.iban").alias("first_iban"), (F.col("_first.v") == values).alias("igual"))
    return firsts.select("path", "id", "_first.v.*"), again


def orders(found: DataFrame) -> DataFrame:
    """The orders of each workbook, by their id in its usual form (the last row counts). Dates may be texts or numbers of days."""
    days = F.col("fecha").try_cast("double").cast("int")
    date = F.when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), days)).otherwise(N.civil_date(F.col("fecha")))
    rows = table(found, ORDERS, ORDER_HEADS).withColumn("pedido", N.order_id(F.col("pedido"))).where("pedido <> ''")
    rows = rows.select(F.struct("path", "pedido").alias("_key"), "row", F.upper(_text("proveedor_id")).alias("proveedor_id"), F.coalesce(N.tax_id(F.col("nif")), F.lit("")).alias("nif"), N.amount(F.col("importe")).alias("importe"), F.upper(_text("estado")).alias("estado"), date.alias("fecha"))
    return last_per_key(rows, "_key", "row").select("_key.path", "_key.pedido", "proveedor_id", "nif", "importe", "estado", "fecha")


def listed_for_review(found: DataFrame) -> DataFrame:
    """path and pedido: orders that any cell of the list for review names."""
    names = F.explode(F.regexp_extract_all("value", F.lit(r"PO[\s\-]?\d{4}[\s\-]?\d{1,4}"), F.lit(0)))
    return found.where(F.col("sheet") == REVIEW).select("path", names.alias("p")).select("path", N.order_id(F.col("p")).alias("pedido")).distinct()


def policy_lines(found: DataFrame) -> DataFrame:
    """path, row and texto of the policy's sheet: its first column."""
    return found.where((F.col("sheet") == POLICY) & (F.col("col") == 1) & (F.trim("value") != "")).select("path", "row", F.trim("value").alias("texto"))
