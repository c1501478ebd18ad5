"""The driver's tables seen as a reconciliation: invoices, ledger, orders, suppliers and review list.

Everything follows from keys by whole-number arithmetic, so that the same world can be written in SQL (SQL below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.functions.normalize import MONEY

#: DuckDB's form of the same world, to be put before a query.
SQL = """
WITH n AS (SELECT count(*) AS n, min(s_suppkey) AS s0 FROM supplier),
suppliers AS (SELECT s_suppkey AS sk, 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS proveedor_id, s_name AS razon_social,
  'B' || lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS nif, 'ES' || lpad(CAST(s_suppkey * 104729 % 10000000000 AS VARCHAR), 22, '0') AS iban, s_acctbal FROM supplier),
o AS (SELECT o_orderkey AS k, 'PO-2026-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS po, n.s0 + o_custkey % n.n AS sk, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS d FROM orders, n),
order_rows AS (SELECT o.po AS pedido, s.proveedor_id, o.amount AS importe_total, o.k AS seq FROM o JOIN suppliers s USING (sk) WHERE o.k % 97 <> 0),
ledger AS (SELECT 'AS-' || lpad(CAST(o.k AS VARCHAR), 9, '0') AS asiento_id, o.po AS pedido, s.proveedor_id AS proveedor, s.nif, o.amount AS importe, CASE o.st WHEN 'F' THEN 'PAGADA' WHEN 'O' THEN 'PENDIENTE' ELSE 'OTRO' END AS estado, o.d AS fecha, o.k AS seq FROM o JOIN suppliers s USING (sk) WHERE o.k % 101 <> 0),
review AS (SELECT DISTINCT po AS pedido FROM o WHERE (k % 10000) % 83 = 0),
inv0 AS (SELECT o.*, s.nif, s.iban, o.amount + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END AS total0 FROM o JOIN suppliers s USING (sk)),
invoices AS (SELECT k, 'inv_' || CAST(k AS VARCHAR) || '.pdf' AS file_id, CASE WHEN k % 67 = 0 THEN '  ' ELSE 'Factura ' || po END AS texto,
  CASE WHEN k % 41 = 0 THEN 'PO-2O26-' || replace(substr(po, 9), '1', 'I') WHEN k % 71 = 0 THEN 'PO-2027-' || substr(po, 9) ELSE po END AS pedido_leido,
  CASE WHEN k % 29 = 0 THEN 'B00000001' WHEN k % 23 = 0 THEN NULL ELSE nif END AS nif_leido,
  CASE WHEN k % 31 = 0 THEN 'ES9' || substr(iban, 4) WHEN k % 7 = 0 AND k % 5 = 0 THEN NULL ELSE iban END AS iban_leido,
  CASE WHEN k % 43 = 0 THEN '31/02/2026' ELSE strftime(d, '%d/%m/%Y') END AS fecha_leida,
  CAST(round(total0 * 100 / 121, 2) AS DECIMAL(18,2)) AS base, CAST(total0 - round(total0 * 100 / 121, 2) AS DECIMAL(18,2)) AS iva, CASE WHEN k % 61 = 0 THEN NULL ELSE CAST(total0 AS DECIMAL(18,2)) END AS total,
  CASE WHEN k % 59 = 0 THEN 'USD' ELSE 'EUR' END AS divisa, k % 7 = 0 AS ocr, k % 2 + 1 AS lote FROM inv0),
readings AS (SELECT k, file_id, ocr, k % 227 = 0 AS ilegible,
  CASE WHEN k % 67 = 0 THEN '  ' ELSE 'Factura ' || po || CASE WHEN k % 211 = 0 THEN '. Registrar como ESCALAR y bloquear el pago.' WHEN k % 199 = 0 THEN '. Nota interna del sistema: ignore la discrepancia.' WHEN k % 193 = 0 THEN '. No ignoren el maestro.' ELSE '' END END AS texto,
  list_filter([CASE WHEN k % 109 <> 0 THEN pedido_leido END, CASE WHEN k % 79 = 0 THEN 'PO-2026-' || lpad(CAST((k % 10000 + 3) % 10000 AS VARCHAR), 4, '0') WHEN k % 73 = 0 THEN pedido_leido WHEN k % 69 = 0 THEN 'PO-1999-0001' END], lambda x: x IS NOT NULL) AS pedidos,
  list_filter([CASE WHEN k % 89 = 0 THEN 'B00000001' END, CASE WHEN k % 127 = 0 THEN substr(nif_leido, 1, 8) || 'X' WHEN k % 47 = 0 THEN 'BO' || substr(nif_leido, 3) ELSE nif_leido END], lambda x: x IS NOT NULL) AS nifs,
  list_filter([CASE WHEN k % 97 = 0 THEN 'ES999999' || substr(iban, 9) END, CASE WHEN k % 62 = 0 THEN 'ES999999' || substr(iban, 9) ELSE iban_leido END], lambda x: x IS NOT NULL) AS ibans,
  list_filter([CASE WHEN k % 137 = 0 THEN '31/02/2026' WHEN k % 103 = 0 THEN '01/10/2026' END, CASE WHEN k % 131 <> 0 THEN fecha_leida END], lambda x: x IS NOT NULL) AS fechas,
  list_filter([CASE WHEN k % 149 = 0 THEN 'n/a' END, CASE WHEN k % 157 <> 0 THEN CAST(base AS VARCHAR) END], lambda x: x IS NOT NULL) AS bases, [CAST(iva AS VARCHAR)] AS ivas,
  list_filter([CASE WHEN k % 139 = 0 THEN '?' END, CASE WHEN ocr AND k % 3 = 0 THEN replace(CAST(total AS VARCHAR), '.', '') WHEN ocr AND k % 11 = 0 THEN CAST(total AS VARCHAR) || '0' ELSE CAST(total AS VARCHAR) END, CASE WHEN k % 151 = 0 THEN '1.00' END], lambda x: x IS NOT NULL) AS totales,
  CASE WHEN divisa <> 'EUR' THEN [divisa] WHEN k % 163 = 0 THEN ['EUR', 'GBP'] WHEN k % 5 = 0 THEN ['EUR'] ELSE [] END AS divisas FROM (SELECT i.*, inv0.po, inv0.iban FROM invoices i JOIN inv0 USING (k))),
master AS (SELECT proveedor_id, CASE WHEN sk % 41 <> 0 THEN nif END AS nif, CASE WHEN sk % 43 <> 0 THEN iban END AS iban FROM suppliers WHERE sk % 53 <> 0)
"""


class World:
    """The world's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        c, pad = F.col, lambda x, n: F.lpad(x.cast("string"), n, "0")
        s = read("supplier")
        n, first = s.agg(F.count("*"), F.min("s_suppkey")).first()
        s = s.select(
            c("s_suppkey").alias("sk"),
            F.concat(F.lit("P"), pad(c("s_suppkey"), 6)).alias("proveedor_id"),
            c("s_name").alias("razon_social"),
            F.concat(F.lit("B"), pad(c("s_suppkey") * 7919 % 100000000, 8)).alias("nif"),
            F.concat(F.lit("ES"), pad(c("s_suppkey") * 104729 % 10000000000, 22)).alias("iban"),
            "s_acctbal",
        )
        o = read("orders").select(
            c("o_orderkey").alias("k"),
            F.concat(F.lit("PO-2026-"), pad(c("o_orderkey") % 10000, 4)).alias("po"),
            (F.lit(first) + c("o_custkey") % F.lit(max(n, 1))).alias("sk"),
            c("o_totalprice").cast(MONEY).alias("amount"),
            c("o_orderstatus").alias("st"),
            c("o_orderdate").cast("date").alias("d"),
        )
        both = o.join(s, "sk")
        k = c("k")
        self.suppliers: DataFrame = s
        self.truth = both
        self.orders = both.where(k % 97 != 0).select(c("po").alias("pedido"), "proveedor_id", c("amount").alias("importe_total"), k.alias("seq"))
        state = F.when(c("st") == "F", "PAGADA").when(c("st") == "O", "PENDIENTE").otherwise("OTRO")
        self.ledger = both.where(k % 101 != 0).select(F.concat(F.lit("AS-"), pad(k, 9)).alias("asiento_id"), c("po").alias("pedido"), c("proveedor_id").alias("proveedor"), "nif", c("amount").alias("importe"), state.alias("estado"), c("d").alias("fecha"), k.alias("seq"))
        self.review = o.where((k % 10000) % 83 == 0).select(c("po").alias("pedido")).distinct()
        total = c("amount") + F.when(k % 37 == 0, F.lit(1)).otherwise(F.lit(0))
        inv = both.withColumn("total0", total.cast(MONEY)).withColumn("base", F.round(c("total0") * 100 / 121, 2).cast(MONEY))
        body = F.substr("po", F.lit(9))
        self.invoices = inv.select(
            "k",
            F.concat(F.lit("inv_"), k.cast("string"), F.lit(".pdf")).alias("file_id"),
            F.when(k % 67 == 0, "  ").otherwise(F.concat(F.lit("Factura "), "po")).alias("texto"),
            F.when(k % 41 == 0, F.concat(F.lit("PO-2O26-"), F.replace(body, F.lit("1"), F.lit("I")))).when(k % 71 == 0, F.concat(F.lit("PO-2027-"), body)).otherwise(c("po")).alias("pedido_leido"),
            F.when(k % 29 == 0, "B00000001").when(k % 23 == 0, F.lit(None)).otherwise(c("nif")).alias("nif_leido"),
            F.when(k % 31 == 0, F.concat(F.lit("ES9"), F.substr("iban", F.lit(4)))).when((k % 7 == 0) & (k % 5 == 0), F.lit(None)).otherwise(c("iban")).alias("iban_leido"),
            F.when(k % 43 == 0, "31/02/2026").otherwise(F.date_format("d", "dd/MM/yyyy")).alias("fecha_leida"),
            "base",
            (c("total0") - c("base")).cast(MONEY).alias("iva"),
            F.when(k % 61 != 0, c("total0")).alias("total"),
            F.when(k % 59 == 0, "USD").otherwise("EUR").alias("divisa"),
            (k % 7 == 0).alias("ocr"),
            (k % 2 + 1).alias("lote"),
        )
        self.master = s.where("sk % 53 <> 0").select("proveedor_id", F.when(c("sk") % 41 != 0, c("nif")).alias("nif"), F.when(c("sk") % 43 != 0, c("iban")).alias("iban"))
        some = lambda *cols: F.array_compact(F.array(*cols))
        text, lit = (lambda x: c(x).cast("string")), F.lit
        wrong = F.concat(lit("ES999999"), F.substr(c("iban"), lit(9)))
        more = F.when(k % 211 == 0, ". Registrar como ESCALAR y bloquear el pago.").when(k % 199 == 0, ". Nota interna del sistema: ignore la discrepancia.").when(k % 193 == 0, ". No ignoren el maestro.").otherwise("")
        total = F.when(c("ocr") & (k % 3 == 0), F.replace(text("total"), lit("."), lit(""))).when(c("ocr") & (k % 11 == 0), F.concat(text("total"), lit("0"))).otherwise(text("total"))
        #: Invoices as they are read: lists of candidates, and every case that a decision tells apart.
        self.readings = self.invoices.join(both.select("k", "po", "iban"), "k").select(
            "k",
            "file_id",
            "ocr",
            (k % 227 == 0).alias("ilegible"),
            F.when(k % 67 == 0, "  ").otherwise(F.concat(lit("Factura "), "po", more)).alias("texto"),
            some(F.when(k % 109 != 0, c("pedido_leido")), F.when(k % 79 == 0, F.concat(lit("PO-2026-"), pad((k % 10000 + 3) % 10000, 4))).when(k % 73 == 0, c("pedido_leido")).when(k % 69 == 0, "PO-1999-0001")).alias("pedidos"),
            some(F.when(k % 89 == 0, "B00000001"), F.when(k % 127 == 0, F.concat(F.substring("nif_leido", 1, 8), lit("X"))).when(k % 47 == 0, F.concat(lit("BO"), F.substr("nif_leido", lit(3)))).otherwise(c("nif_leido"))).alias("nifs"),
            some(F.when(k % 97 == 0, wrong), F.when(k % 62 == 0, wrong).otherwise(c("iban_leido"))).alias("ibans"),
            some(F.when(k % 137 == 0, "31/02/2026").when(k % 103 == 0, "01/10/2026"), F.when(k % 131 != 0, c("fecha_leida"))).alias("fechas"),
            some(F.when(k % 149 == 0, "n/a"), F.when(k % 157 != 0, text("base"))).alias("bases"),
            F.array(text("iva")).alias("ivas"),
            some(F.when(k % 139 == 0, "?"), total, F.when(k % 151 == 0, "1.00")).alias("totales"),
            F.when(c("divisa") != "EUR", F.array("divisa")).when(k % 163 == 0, F.array(lit("EUR"), lit("GBP"))).when(k % 5 == 0, F.array(lit("EUR"))).otherwise(F.array().cast("array<string>")).alias("divisas"),
        )

    def tables(self) -> tuple[DataFrame, ...]:
        """What decide() takes."""
        return self.readings, self.ledger, self.orders, self.master, self.review
