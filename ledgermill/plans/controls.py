"""Registered queries of gates, audits and readings of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import readings
from ledgermill.operators import controls
from ledgermill.plans.catalog import DECIDED, _t, conformance_classes, decisions, query
from ledgermill.plans.catalog import ORACLES as KNOWN
from ledgermill.plans.world import SQL as WORLD
from ledgermill.plans.world import World

_CLASSES = "WITH cls AS (" + KNOWN["conformance_classes"] + "), "
_ENTRIES = "e AS (SELECT CASE WHEN o_orderkey % 700 = 0 THEN ' ' WHEN o_orderkey % 450 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS k, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'alto' WHEN 2 THEN ' BAJO' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'RARO' ELSE 'MEDIO' END END AS clase, CASE WHEN o_orderkey % 110 = 0 THEN ' ' ELSE 'visto' END AS motivo, o_orderkey AS seq FROM orders WHERE o_orderkey % 10 IN (0, 3, 5, 9) AND o_orderkey % 7 < 3), ee AS (SELECT * FROM e UNION ALL SELECT k, 'ALTO', 'de nuevo', seq + 1 FROM e WHERE seq % 77 = 0), "
_HELD = (
    _CLASSES
    + _ENTRIES
    + """f AS (SELECT trim(k) AS k, upper(trim(clase)) AS c, seq, CASE WHEN trim(k) = '' THEN 'sin_file_id' WHEN trim(motivo) = '' THEN 'sin_motivo' WHEN upper(trim(clase)) NOT IN ('', 'ALTO', 'MEDIO', 'FALTA', 'BAJO', 'EXTRA', 'NO_PRIMARIO', 'OK') THEN 'clase_desconocida' END AS flaw FROM ee),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS pos FROM f WHERE flaw IS NULL),
held AS (SELECT r.k, CASE WHEN pos > 1 THEN 'repetida' WHEN conformance IS NULL THEN 'ausente' WHEN conformance = 'OK' THEN 'ya_conforme' WHEN c <> '' AND c <> conformance THEN 'otra_clase' END AS problem FROM r LEFT JOIN cls ON CAST(cls.k AS VARCHAR) = r.k UNION ALL SELECT k, flaw FROM f WHERE flaw IS NOT NULL) """
)


def _held(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 700 == 0, " ").when(k % 450 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string"))
    kind = F.when(k % 4 == 0, "").when(k % 4 == 1, "alto").when(k % 4 == 2, " BAJO").when(k % 9 == 0, "RARO").otherwise("MEDIO")
    e = _t(spark, sf_dir, "orders").where((k % 10).isin(0, 3, 5, 9) & (k % 7 < 3)).select(name.alias("k"), kind.alias("clase"), F.when(k % 110 == 0, " ").otherwise("visto").alias("motivo"), k.alias("seq"))
    again = e.where("seq % 77 = 0").select("k", F.lit("ALTO").alias("clase"), F.lit("de nuevo").alias("motivo"), (F.col("seq") + 1).alias("seq"))
    return controls.accepted_exceptions(conformance_classes(spark, sf_dir), e.union(again), "k")


@query(_HELD + "SELECT k, problem FROM held")
def accepted_exceptions(spark, sf_dir):
    return _held(spark, sf_dir)


@query(
    _HELD
    + """, s AS (SELECT k, bool_or(problem IS NULL) AS taken, bool_or(problem = 'otra_clase') AS blocked FROM held GROUP BY k), v AS (SELECT CASE WHEN conformance IN ('ALTO', 'MEDIO', 'FALTA') THEN cls.k % 2 WHEN conformance = 'OK' THEN 2 + cls.k % 2 ELSE 2 END AS part, conformance, coalesce(taken, false) AS taken, coalesce(blocked, false) AS blocked FROM cls LEFT JOIN s ON CAST(cls.k AS VARCHAR) = s.k),
g AS (SELECT part, count(*) FILTER (conformance = 'ALTO' AND NOT taken) AS n_alto, count(*) FILTER (conformance = 'MEDIO' AND NOT taken) AS n_medio, count(*) FILTER (conformance = 'FALTA' AND NOT taken) AS n_falta, count(*) FILTER (conformance = 'BAJO' AND NOT taken) AS n_bajo, count(*) FILTER (conformance = 'EXTRA' AND NOT taken) AS n_extra, count(*) FILTER (conformance = 'NO_PRIMARIO' AND NOT taken) AS n_no_primario, count(*) FILTER (conformance = 'OK' AND NOT taken) AS n_ok, count(*) FILTER (taken) AS n_aceptado, count(*) FILTER (blocked AND part < 2) AS n_bloqueo FROM v GROUP BY 1)
SELECT *, CASE WHEN n_alto + n_medio + n_falta + n_bloqueo > 0 THEN 'NO CONFORME' WHEN n_bajo + n_extra + n_no_primario > 0 THEN 'CONFORME CON MATICES' ELSE 'CONFORME (ESTRICTO)' END AS veredicto, CASE WHEN n_alto + n_medio + n_falta + n_bloqueo > 0 THEN 1 WHEN n_bajo + n_extra + n_no_primario > 0 THEN 2 ELSE 0 END AS codigo FROM g"""
)
def conformance_verdict(spark, sf_dir):
    c = F.col("conformance")
    s = _held(spark, sf_dir).groupBy("k").agg(F.bool_or(F.col("problem").isNull()).alias("taken"), F.bool_or(F.col("problem") == "otra_clase").alias("blocked"))
    rows = conformance_classes(spark, sf_dir).withColumn("id", F.col("k").cast("string")).join(s.withColumnRenamed("k", "id"), "id", "left")
    part = F.when(c.isin("ALTO", "MEDIO", "FALTA"), F.col("k") % 2).when(c == "OK", 2 + F.col("k") % 2).otherwise(2)
    return controls.verdict(rows.withColumn("part", part), ["part"], blocked=F.col("blocked") & (F.col("part") < 2), taken=F.col("taken"))


@query(DECIDED + "SELECT file_id, CASE WHEN i.k % 9 = 0 THEN 'ESCALAR' ELSE resultado END AS before, CASE WHEN i.k % 11 <> 0 THEN resultado END AS after, CASE WHEN i.k % 11 = 0 THEN 'only_a' ELSE 'changed' END AS kind FROM decisions JOIN invoices i USING (file_id) WHERE i.k % 11 = 0 OR (i.k % 9 = 0 AND resultado <> 'ESCALAR')")
def drift_from_gold(spark, sf_dir):
    d = decisions(spark, sf_dir).select("file_id", "resultado", F.regexp_extract("file_id", "([0-9]+)", 1).cast("long").alias("k"))
    gold = d.select("file_id", F.when(F.col("k") % 9 == 0, "ESCALAR").otherwise(F.col("resultado")).alias("resultado"))
    return controls.drift(d.where("k % 11 <> 0"), gold, "file_id", "resultado")


@query(
    """WITH n AS (SELECT o_orderkey AS k, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['pedido PO-2O26-1 reparado a PO-2026-0001', 'importe recompuesto a 12.00'] WHEN 1 THEN [' NIF B1 no figura en el maestro'] WHEN 2 THEN ['IBAN ES1 corregido a ES2', 'IBAN ES1 corregido a ES2'] WHEN 3 THEN ['nota ' || (o_orderkey % 4)] WHEN 4 THEN ['pedido PO-1 no existe en el ERP', 'total ilegible o ruidoso (1)'] ELSE [] END) AS note FROM orders),
c AS (SELECT k, CASE WHEN note LIKE 'pedido%reparado%' OR note LIKE 'importe%' OR note LIKE 'IBAN%corregido%' OR note LIKE 'total%' THEN 'reparacion' WHEN note LIKE 'nota%' THEN 'sin_clasificar' ELSE 'hueco' END AS tipo, CASE WHEN note LIKE 'pedido%' THEN 'pedido' WHEN note LIKE 'i%' OR note LIKE 't%' THEN 'importe' WHEN note LIKE 'IBAN%' THEN 'iban' WHEN note LIKE ' NIF%' THEN 'nif' ELSE '' END AS campo,
CASE WHEN note LIKE 'pedido%reparado%' THEN 'pedido reparado (venia mal impreso)' WHEN note LIKE 'importe%' THEN 'total recompuesto (separador decimal desalineado)' WHEN note LIKE 'IBAN%' THEN 'IBAN corregido' WHEN note LIKE 'total%' THEN 'total confirmado por la aritmetica del documento' WHEN note LIKE 'nota%' THEN note WHEN note LIKE ' NIF%' THEN 'NIF que no figura en el maestro' ELSE 'pedido citado que no existe en el ERP' END AS etiqueta FROM n)
SELECT tipo, campo, etiqueta, count(*) AS notas, count(DISTINCT k) AS facturas, round(count(DISTINCT k) / (SELECT count(*) FROM orders), 4) AS tasa FROM c GROUP BY GROUPING SETS ((tipo), (tipo, campo), (tipo, campo, etiqueta))"""
)
def notes_census(spark, sf_dir):
    k, lit = F.col("o_orderkey"), F.lit
    kinds = [["pedido PO-2O26-1 reparado a PO-2026-0001", "importe recompuesto a 12.00"], [" NIF B1 no figura en el maestro"], ["IBAN ES1 corregido a ES2"] * 2, None, ["pedido PO-1 no existe en el ERP", "total ilegible o ruidoso (1)"], []]
    notes = F.array().cast("array<string>")
    for m, texts in enumerate(kinds):
        value = F.array(F.concat(lit("nota "), k % 4)) if texts is None else F.array(*map(lit, texts)).cast("array<string>")
        notes = F.when(k % 6 == m, value).otherwise(notes)
    return controls.notes_census(_t(spark, sf_dir, "orders"), "o_orderkey", notes)


@query(
    WORLD
    + """SELECT file_id, 'iban' AS campo, 'critico' AS gravedad FROM invoices WHERE iban_leido IS NOT NULL AND k % 6 <> 0 AND k % 4 = 0
UNION ALL SELECT file_id, 'total', 'critico' FROM invoices WHERE total IS NOT NULL AND k % 5 = 0
UNION ALL SELECT file_id, 'pedido', 'medio' FROM invoices WHERE k % 8 = 0"""
)
def reading_divergences(spark, sf_dir):
    c, k = F.col, F.col("k")
    spanish = F.concat(F.translate(F.format_number("total", 2), ",.", ".,"), F.lit(" €"))
    iban = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(k % 4 == 0, F.lit("ES00")).otherwise(F.regexp_replace(F.lower("iban_leido"), "(.{4})", "$1 "))))
    fields = F.array(
        F.struct(F.lit("iban").alias("campo"), F.array("iban_leido").alias("capa"), iban.alias("ocr")),
        F.struct(F.lit("total").alias("campo"), F.array(c("total").cast("string")).alias("capa"), F.array(F.when(k % 5 == 0, "0,01").otherwise(spanish)).alias("ocr")),
        F.struct(F.lit("pedido").alias("campo"), F.array(c("pedido_leido")).alias("capa"), F.when(k % 8 == 0, F.array(F.lit("PO"))).otherwise(F.array(F.lit("PO"), F.replace("pedido_leido", F.lit("-"), F.lit(" ")))).alias("ocr")),
    )
    return controls.divergences(World(spark, sf_dir).invoices.select("file_id", F.inline(fields)), "file_id")


@query("SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS n_same_text, count(*) FILTER (doc_id % 4 <> 1) AS n_same_values FROM documents GROUP BY 1")
def reader_agreement(spark, sf_dir):
    k = F.col("doc_id")
    d = _t(spark, sf_dir, "documents").select("lang", F.col("text").alias("text_a"), F.when(k % 3 != 0, F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("text_b"), F.array(k).alias("values_a"), F.array(k + F.when(k % 4 == 1, 1).otherwise(0)).alias("values_b"))
    return controls.agreement(d, ["lang"])


@query("SELECT d.user_id, count(e.value) AS n_lines, coalesce(round(avg(e.value), 6), 0) AS mean_score, coalesce(round(min(e.value), 6), 0) AS min_score FROM (SELECT DISTINCT user_id FROM events) d LEFT JOIN events e ON e.user_id = d.user_id AND e.event_type = 'view' GROUP BY 1")
def scan_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return controls.scan_summary(e, e.where("event_type = 'view'").select("user_id", F.col("value").alias("score")), "user_id")


@query("SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, bool_or(event_type = 'purchase') AS complete FROM events GROUP BY 1")
def finished_streams(spark, sf_dir):
    return controls.finished(_t(spark, sf_dir, "events"), "user_id", "event_type", "purchase", "error")


@query("SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'campo_no_corregible' WHEN event_id % 5 = 0 THEN 'valor_vacio' WHEN event_id % 7 = 0 THEN 'valor_demasiado_largo' END AS problem FROM events")
def correction_problems(spark, sf_dir):
    k = F.col("event_id")
    names = F.array(*map(F.lit, ["pedido", "nif", "iban", "fecha", "base", "iva", "total", "nif", "notas"]))
    value = F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 5 == 0, "  ").when(k % 7 == 0, F.repeat(F.lit("9"), 201)).otherwise(F.repeat(F.lit("9"), 200))
    return _t(spark, sf_dir, "events").select(k, controls.correction_problem(F.element_at(names, (k % 9 + 1).cast("int")), value).alias("problem"))


@query(
    WORLD
    + """SELECT asiento_id, unnest(list_filter([CASE WHEN seq % 13 = 0 THEN 'falta ''nif''' END, CASE WHEN seq % 17 = 0 THEN 'falta ''vigente''' END, CASE WHEN estado = 'OTRO' THEN 'estado fuera: OTRO' END, CASE WHEN seq % 17 = 0 THEN '''vigente'' no es booleano' END, CASE WHEN seq % 19 = 0 THEN 'importe ilegible' END], lambda x: x IS NOT NULL)) AS problem FROM ledger"""
)
def import_problems(spark, sf_dir):
    s = F.col("seq")
    led = World(spark, sf_dir).ledger
    entries = led.select("asiento_id", F.lit("s1").alias("snapshot_id"), F.when(s % 13 != 0, F.col("nif")).alias("nif"), "pedido", F.when(s % 19 == 0, "doce").otherwise(F.col("importe").cast("string")).alias("importe"), "estado", F.when(s % 17 != 0, F.lit(True)).alias("vigente"))
    return controls.entry_problems(entries)


@query("SELECT event_type AS message, count(*) AS n, min(event_id) AS first_line, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 5), ', ') || CASE WHEN count(*) > 5 THEN ' y ' || (count(*) - 5) || ' mas' ELSE '' END AS lines FROM events GROUP BY 1")
def grouped_warnings(spark, sf_dir):
    return controls.grouped_messages(_t(spark, sf_dir, "events").select(F.col("event_type").alias("message"), "event_id"), "message", "event_id")


@query(
    WORLD
    + """, m AS (SELECT proveedor_id, nif, iban, sk AS row FROM suppliers UNION ALL SELECT proveedor_id, nif, CASE WHEN sk % 3 = 0 THEN 'ES' ELSE iban END, sk + 1000000 FROM suppliers WHERE sk % 2 = 0 UNION ALL SELECT proveedor_id, nif, iban, sk + 2000000 FROM suppliers WHERE sk % 5 = 0), r AS (SELECT *, first_value(iban) OVER (PARTITION BY proveedor_id ORDER BY row) AS kept FROM m)
SELECT proveedor_id, arg_min(nif, row) AS nif, arg_min(iban, row) AS iban, min(row) AS row, count(*) FILTER (iban = kept) - 1 AS identical, count(*) FILTER (iban <> kept) AS conflicting FROM r GROUP BY 1"""
)
def supplier_first_rows(spark, sf_dir):
    s = World(spark, sf_dir).suppliers.select("proveedor_id", "nif", "iban", "sk")
    copy = lambda where, iban, step: s.where(where).select("proveedor_id", "nif", iban.alias("iban"), (F.col("sk") + step).alias("row"))
    m = copy("true", F.col("iban"), 0).union(copy("sk % 2 = 0", F.when(F.col("sk") % 3 == 0, "ES").otherwise(F.col("iban")), 1000000)).union(copy("sk % 5 = 0", F.col("iban"), 2000000))
    return controls.first_rows(m, "proveedor_id", "row")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return controls.repeated(_t(spark, sf_dir, "lineitem"), "l_orderkey")


@query("WITH f AS (SELECT o_orderkey, o_orderkey % 400 = 0 AS marked FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY md5('s7' || o_orderkey), o_orderkey) AS r FROM f WHERE NOT marked) SELECT o_orderkey, marked FROM f WHERE marked UNION ALL SELECT o_orderkey, marked FROM r WHERE r <= 100 - (SELECT count(*) FROM f WHERE marked)")
def audit_sample(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 == 0).alias("marked"))
    return controls.marked_sample(o, "o_orderkey", F.col("marked"), 100, "s7")


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS p, CAST(l_quantity AS INT) AS q, format('{:.2f}', l_extendedprice) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, 3 AS n_amounts, round(2 * p + q + 0.5, 2) AS total, q + 0.5 AS least, replace(w, '.', ',') || '121' AS malformed FROM t"""
)
def scanned_amounts(spark, sf_dir):
    li, price = _t(spark, sf_dir, "lineitem"), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    text = F.concat(F.lit("Base "), price, F.lit(" IVA 21 total "), price, F.lit(" fecha 11/04/2026 neto "), F.col("l_quantity").cast("int"), F.lit(".5 mal "), F.replace(price, F.lit("."), F.lit("")), F.lit("121"))
    rows = li.select("l_orderkey", "l_linenumber", readings.plausible_amounts(text).alias("a"), readings.run_together(text).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.size("a").alias("n_amounts"), F.round(F.aggregate("a", F.lit(0.0), lambda x, y: x + y), 2).alias("total"), F.get("a", F.lit(0)).alias("least"), F.array_join("m", ";").alias("malformed"))


@query(
    """WITH x AS (SELECT o_orderkey AS k, format('{:,.2f}', CASE WHEN o_orderkey % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 99999 / 100.0 ELSE o_totalprice * 1000 END) AS w FROM orders), y AS (SELECT k, w, translate(w, ',.', '.,') AS es FROM x)
SELECT k, 'Importe ' || CASE WHEN k % 5 <> 0 THEN es ELSE CASE k % 3 WHEN 0 THEN replace(w, ',', '.') WHEN 1 THEN replace(w, '.', ',') ELSE es END END || ' EUR' AS text FROM y"""
)
def spanish_amounts(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    w = F.format_number(F.when(k % 5 == 0, F.round(price * 100).cast("long") % 99999 / 100).otherwise(price * 1000), 2)
    shown = F.when(k % 3 == 0, F.replace(w, F.lit(","), F.lit("."))).when(k % 3 == 1, F.replace(w, F.lit("."), F.lit(","))).otherwise(F.translate(w, ",.", ".,"))
    return _t(spark, sf_dir, "orders").select(k.alias("k"), readings.spanish_amounts(F.concat(F.lit("Importe "), shown, F.lit(" EUR"))).alias("text"))


@query("SELECT doc_id, md5(translate(translate(translate(text, 'aeiou z', '┴ÊÝ±Ç' || chr(160) || chr(8203)), chr(160) || '═┴ÊÝßÚ§±Ç', ' ÍÁÍíáÉçñ€'), chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(8206) || chr(8207) || chr(65279) || chr(173), '')) AS digest FROM documents")
def searchable_text(spark, sf_dir):
    damaged = F.translate("text", "aeiou z", "┴ÊÝ±Ç ​")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(readings.searchable(damaged).cast("binary")).alias("digest"))
