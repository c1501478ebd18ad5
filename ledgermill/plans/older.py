"""Registered queries of the older reconciliation: evidence, and decisions with the rules that were looked at."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.operators import legacy
from ledgermill.plans.catalog import query
from ledgermill.plans.world import SQL as WORLD
from ledgermill.plans.world import World

_BLOCKED = ["B00007919", "B00015838"]

# By SQL: every invoice with every ledger and workbook row that it may be about.
_EVIDENCE = (
    WORLD
    + """,
led AS (SELECT asiento_id, CASE WHEN seq % 51 = 0 THEN NULL WHEN seq % 109 = 0 THEN 'U' || seq ELSE nif END AS nif, pedido, importe, estado, seq FROM ledger),
inv AS (SELECT file_id, k, CASE WHEN k % 109 = 0 THEN 'U' || k ELSE nif_leido END AS nif, CASE WHEN k % 218 = 0 THEN 'PO-2027-99/99' WHEN k % 109 = 0 OR k % 46 = 0 THEN NULL ELSE lower(pedido_leido) END AS pedido,
  CAST(total + CASE WHEN k % 109 = 0 THEN 5 WHEN k % 17 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS total, k % 92 = 0 AS nif_ilegible, CASE WHEN k % 19 <> 0 THEN 'A58231074' END AS cif_cliente, k % 38 = 0 AS cif_ilegible,
  CASE WHEN k % 11 = 0 THEN 0.5 ELSE 0.98 END AS score, k % 113 = 0 AS ilegible FROM invoices),
book AS (SELECT 'fila-' || k AS id, nif, CASE WHEN k % 8 <> 0 THEN po END AS pedido, CASE k % 3 WHEN 0 THEN 'Pagado' WHEN 1 THEN 'pendiente de pago' END AS estado, CASE WHEN k % 5 <> 0 THEN CAST(amount + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS importe, k AS seq
  FROM o JOIN suppliers USING (sk) WHERE sk % 4 = 0 AND (k % 3 = 0 OR k % 7 = 0)),
ik AS (SELECT *, regexp_replace(upper(pedido), '[^A-Z0-9]', '', 'g') AS pk FROM inv), lk AS (SELECT *, replace(pedido, '-', '') AS pk FROM led), bk AS (SELECT *, replace(pedido, '-', '') AS pk FROM book),
e1 AS (SELECT file_id, count(*) AS n, min(asiento_id) AS a FROM ik JOIN lk USING (pk) GROUP BY 1),
e2 AS (SELECT file_id, count(*) AS n, min(asiento_id) AS a FROM ik JOIN lk ON ik.nif = lk.nif AND abs(importe - total) <= 0.01 GROUP BY 1),
once AS (SELECT nif, min(asiento_id) AS a FROM lk WHERE nif IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
f0 AS (SELECT ik.*, coalesce(e1.n, 0) AS n1, coalesce(e2.n, 0) AS n2, CASE WHEN e1.n = 1 THEN 'pedido' WHEN e2.n = 1 THEN 'nif_importe' WHEN once.a IS NOT NULL THEN 'nif_unico' ELSE 'ninguno' END AS match_por,
  CASE WHEN e1.n = 1 THEN e1.a WHEN e2.n = 1 THEN e2.a ELSE once.a END AS asiento_id FROM ik LEFT JOIN e1 USING (file_id) LEFT JOIN e2 USING (file_id) LEFT JOIN once ON once.nif = ik.nif),
f1 AS (SELECT f0.*, lk.nif AS nif_erp, lk.pedido AS pedido_erp, lk.pk AS pk_erp, lk.importe AS importe_erp, lk.estado AS estado_erp FROM f0 LEFT JOIN lk USING (asiento_id)),
b1 AS (SELECT file_id, count(*) AS n_filas, arg_min(id, (b.pk IS DISTINCT FROM f1.pk, b.seq)) AS primera_fila,
  count(*) FILTER (CASE WHEN estado_erp = 'PAGADA' THEN b.estado = 'pendiente de pago' WHEN asiento_id IS NOT NULL THEN b.estado = 'Pagado' END) AS n_estado, count(*) FILTER (abs(b.importe - importe_erp) > 0.01) AS n_importe FROM f1 JOIN bk b ON b.pk = f1.pk OR b.nif = f1.nif GROUP BY 1),
found AS (SELECT f1.*, coalesce(n_filas, 0) AS n_filas, primera_fila, CASE WHEN n1 > 1 THEN n1 ELSE 0 END AS n_mismo_pedido, CASE WHEN n1 <> 1 AND n2 > 1 THEN n2 ELSE 0 END AS n_mismo_importe, CAST(coalesce(match_por = 'pedido' AND nif <> nif_erp, false) AS BIGINT) AS nif_distinto,
  CAST(coalesce(match_por LIKE 'nif%' AND pk <> pk_erp, false) AS BIGINT) AS pedido_distinto, coalesce(n_estado, 0) AS n_estado, coalesce(n_importe, 0) AS n_importe FROM f1 LEFT JOIN b1 USING (file_id))
"""
)
_COUNTS = "n_filas, primera_fila, n_mismo_pedido, n_mismo_importe, nif_distinto, pedido_distinto, n_estado, n_importe"


def _inputs(spark, sf_dir):
    w, c, lit = World(spark, sf_dir), F.col, F.lit
    k, seq = c("k"), c("seq")
    ledger = w.ledger.withColumn("nif", F.when(seq % 51 == 0, None).when(seq % 109 == 0, F.concat(lit("U"), seq.cast("string"))).otherwise(c("nif")))
    invoices = w.invoices.select(
        "file_id",
        F.when(k % 109 == 0, F.concat(lit("U"), k.cast("string"))).otherwise(c("nif_leido")).alias("nif"),
        F.when(k % 218 == 0, "PO-2027-99/99").when((k % 109 == 0) | (k % 46 == 0), None).otherwise(F.lower("pedido_leido")).alias("pedido"),
        (c("total") + F.when(k % 109 == 0, 5).when(k % 17 == 0, lit("0.01").cast("decimal(3,2)")).otherwise(0)).cast("decimal(18,2)").alias("total"),
        (k % 92 == 0).alias("nif_ilegible"),
        F.when(k % 19 != 0, "A58231074").alias("cif_cliente"),
        (k % 38 == 0).alias("cif_ilegible"),
        F.array(
            F.struct(lit("nif_emisor").alias("nombre"), lit(False).alias("ilegible"), lit(None).cast("string").alias("crudo"), lit("").alias("donde"), F.when(k % 11 == 0, 0.5).otherwise(0.98).alias("score")),
            F.struct(lit("total").alias("nombre"), (k % 113 == 0).alias("ilegible"), F.when(k % 2 == 0, "1x0").alias("crudo"), lit("pág. 1").alias("donde"), lit(None).cast("double").alias("score")),
        ).alias("campos"),
    )
    book = w.truth.where("sk % 4 = 0 and (k % 3 = 0 or k % 7 = 0)").select(
        F.concat(lit("fila-"), k.cast("string")).alias("id"),
        "nif",
        F.when(k % 8 != 0, c("po")).alias("pedido"),
        F.when(k % 3 == 0, "Pagado").when(k % 3 == 1, "pendiente de pago").alias("estado"),
        F.when(k % 5 != 0, c("amount") + F.when(k % 13 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("importe"),
        k.alias("seq"),
    )
    return invoices, ledger, book


@query(_EVIDENCE + f"SELECT file_id, match_por, asiento_id, {_COUNTS} FROM found")
def legacy_evidence(spark, sf_dir):
    found = legacy.evidence(*_inputs(spark, sf_dir))
    return found.select("file_id", "match_por", "asiento.asiento_id", *_COUNTS.split(", "))


_EUROS = "replace(CAST({} AS VARCHAR), '.', ',')"


@query(
    _EVIDENCE
    + f""", why AS (SELECT *, asiento_id IS NOT NULL AS has, coalesce(nif, nif_erp) AS supplier,
  concat_ws('; ', CASE WHEN n_mismo_pedido > 0 THEN n_mismo_pedido || ' asientos con el pedido ' || pedido END, CASE WHEN n_mismo_importe > 0 THEN n_mismo_importe || ' asientos con el NIF ' || nif || ' y el importe ' || {_EUROS.format("total")} END,
    CASE WHEN nif_distinto > 0 THEN 'NIF ' || nif || ' frente a ' || nif_erp || ' en ' || asiento_id END, CASE WHEN pedido_distinto > 0 THEN 'pedido ' || pedido || ' frente a ' || pedido_erp || ' en ' || asiento_id END,
    CASE WHEN n_estado > 0 THEN n_estado || ' filas del Excel con otro estado que ' || asiento_id END, CASE WHEN n_importe > 0 THEN n_importe || ' filas del Excel con otro importe que ' || asiento_id END) AS conflicts,
  concat_ws(', ', CASE WHEN score < 0.85 THEN 'nif_emisor (0.50)' END, CASE WHEN ilegible THEN 'total ilegible (' || CASE WHEN k % 2 = 0 THEN '1x0' ELSE '¿?' END || ', pág. 1)' END) AS doubt FROM found),
ruled AS (SELECT *, CASE WHEN nif IS NULL AND pedido IS NULL THEN 1 WHEN cif_cliente IS NULL THEN 2 WHEN supplier IN ('{_BLOCKED[0]}', '{_BLOCKED[1]}') THEN 3 WHEN has AND estado_erp = 'PAGADA' THEN 4
  WHEN has AND conflicts <> '' THEN 5 WHEN has AND doubt <> '' THEN 6 WHEN has AND nif_erp IS NULL THEN 7 WHEN has AND abs(total - importe_erp) <= 0.01 THEN 8 WHEN has THEN 9 WHEN n_filas > 0 THEN 10 ELSE 11 END AS step FROM why)
SELECT file_id, CASE WHEN step IN (3, 4) THEN 'NO_PAGAR' WHEN step = 8 THEN 'PAGAR' ELSE 'ESCALAR' END AS resultado,
  CASE step WHEN 1 THEN CASE WHEN nif_ilegible THEN 'NIF ilegible y ningún pedido' ELSE 'ni NIF ni pedido' END WHEN 2 THEN CASE WHEN cif_ilegible THEN 'CIF del cliente ilegible' ELSE 'sin CIF del cliente' END WHEN 3 THEN 'proveedor ' || supplier || ' en la lista de pago prohibido'
    WHEN 4 THEN 'asiento ' || asiento_id || ' PAGADA' WHEN 5 THEN 'conflicto entre fuentes: ' || conflicts WHEN 6 THEN 'extracción dudosa en ' || doubt WHEN 7 THEN 'asiento ' || asiento_id || ' sin NIF en el ERP' WHEN 8 THEN 'asiento ' || asiento_id || ' PENDIENTE, importes conciliados'
    WHEN 9 THEN CASE WHEN total IS NULL THEN 'asiento ' || asiento_id || ' PENDIENTE y ningún importe en el documento' ELSE 'descuadre: documento ' || {_EUROS.format("total")} || ', ERP ' || {_EUROS.format("importe_erp")} END
    WHEN 10 THEN 'no consta en el ERP; ' || n_filas || ' filas del Excel desde ' || primera_fila ELSE 'en ninguna fuente' END AS motivo,
  concat_ws(',', 'R1_sin_identificadores', CASE WHEN step >= 2 THEN 'R1_sin_cif_cliente' END, CASE WHEN step >= 3 THEN 'R2_prohibido_pagar_proveedor' END, CASE WHEN step >= 4 THEN 'R3_erp_pagada' END, CASE WHEN has AND step >= 5 THEN 'R4_conflicto_fuentes' END, CASE WHEN has AND step >= 6 THEN 'R5_extraccion_dudosa' END,
    CASE WHEN has AND step >= 7 THEN 'R10_erp_sin_nif' END, CASE WHEN has AND step >= 8 THEN 'R6_erp_pendiente_conciliado' END, CASE WHEN step = 9 THEN 'R7_erp_pendiente_descuadre' END, CASE WHEN step >= 10 THEN 'R8_sin_erp_con_excel' END, CASE WHEN step = 11 THEN 'R9_sin_match' END) AS evaluadas FROM ruled"""
)
def legacy_decisions(spark, sf_dir):
    invoices, ledger, book = _inputs(spark, sf_dir)
    out = legacy.decisions(invoices, legacy.evidence(invoices, ledger, book), _BLOCKED)
    return out.withColumn("evaluadas", F.array_join("evaluadas", ","))
