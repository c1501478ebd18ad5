"""Registered queries over files that Spark writes from the given tables and reads again: traces of two lots, the strict contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import contract, trace_rows
from ledgermill.plans.catalog import _t, query
from ledgermill.plans.world import SQL as WORLD
from ledgermill.plans.world import World
from ledgermill.sources import logs
from ledgermill.sources.scratch import shared


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _written(lines: DataFrame, order: str, spark, name: str) -> str:
    """The path of text files that hold the lines in their order, file after file."""
    path = shared(spark, name)
    lines.orderBy(order).select("line").write.text(path)
    return path


def _two_lots(spark, sf_dir) -> DataFrame:
    """Decisions as a flat trace and as a chained one (with its other events), some lines of them spoiled, and notes of a queue."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    # Ids come again, within a lot and across lots.
    file_id = F.when(k % 43 == 0, "  ").otherwise(_text("inv_", k % 2999, ".pdf"))
    amount = F.when(k % 5 == 0, '"1 234,5"').when(k % 5 == 1, "true").otherwise(_text('"', k, '.25"'))
    declared = F.when(k % 6 == 0, ',"divisa_documento":["eur"," usd"]').when(k % 6 == 1, ',"divisa_documento":"gbp"').otherwise("")
    fields = _text('{"proveedor":" S', k % 9, ' ","proveedor_id":"P', k % 9, '","nif_maestro":"', F.when(k % 4 == 0, " ").otherwise("B1"), '","nif_asiento":"N', k % 11, '","asiento":"AS-', k, '","pedido":null,"total":', amount, ',"importe_erp":', k, ',"estado_erp":"PAGADA"', declared, "}")
    body = _text('"result":"', F.when(k % 2 == 0, "PAGAR").otherwise("ESCALAR"), '","motivos":[', F.when(k % 10 == 0, '"m1","m2"').when(k % 10 == 1, '" "').otherwise(""), '],"hechos":[{"regla":"R3","ok":true},{"regla":"R', k % 7, '","ok":false,"duro":false,"motivo":"', F.when(k % 3 == 0, "").otherwise("h"), '"}],"campos":', fields, ',"lote":', k % 3, ',"metodo_lectura":"m', k % 2, '","calidad_lectura":0.5,"segundos_lectura":"', k % 4, ',5","identificacion_fiable":', F.when(k % 2 == 0, "true").otherwise("false"), ',"version_norma":"v1"')
    flat = F.when(k % 41 == 0, "{x").otherwise(_text(' {"file_id":"', file_id, '",', body, "}"))
    chained = F.when(k % 41 == 0, '{"a":1}{').otherwise(_text('{"seq":', k, ',"tipo":"decision","file_id":"', file_id, '","datos":{', body, "}}"))
    reading = _text('{"seq":0,"tipo":"lectura","file_id":"', file_id, '","datos":{"result":"x"}}\n')
    first = _written(o.where("k % 3 <> 0").select("k", flat.alias("line")), "k", spark, "lot")
    # Lines of text with a break become two lines of the file.
    second = _written(o.where("k % 3 = 0").select("k", F.concat(reading, F.lit("\n"), chained).alias("line")), "k", spark, "lot")
    note = _text('{"file_id":"', file_id, '","segunda_lectura":{"confirmable":', F.when(k % 4 == 0, "true").otherwise("false"), "}}")
    notes = _written(o.where("k % 17 = 0").select("k", F.when(k % 2 == 0, note).otherwise(F.lit("[]")).alias("line")), "k", spark, "queue")
    return logs.trace_records(spark, [first, second], logs.queue_notes(spark, notes))


_LOTS = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS src, CASE WHEN o_orderkey % 41 = 0 THEN 'ilegible' WHEN o_orderkey % 43 = 0 THEN 'sin_file_id' END AS problem, CASE WHEN o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 THEN 'inv_' || o_orderkey % 2999 || '.pdf' END AS file_id FROM orders),
q AS (SELECT 'inv_' || o_orderkey % 2999 || '.pdf' AS file_id, arg_max(o_orderkey % 4 = 0, o_orderkey) AS confirmable FROM orders WHERE o_orderkey % 34 = 0 AND o_orderkey % 43 <> 0 GROUP BY 1)
"""


@query(
    _LOTS
    + """SELECT file_id, CASE WHEN k % 2 = 0 THEN 'PAGAR' ELSE 'ESCALAR' END AS resultado, CASE WHEN k % 10 = 0 THEN 'm1' WHEN k % 3 = 0 THEN 'R' || k % 7 ELSE 'h' END AS motivo_principal, 'S' || k % 9 AS proveedor, 'P' || k % 9 AS proveedor_id, CASE WHEN k % 4 = 0 THEN 'N' || k % 11 ELSE 'B1' END AS nif, 'AS-' || k AS asiento,
  CAST(NULL AS VARCHAR) AS pedido, CAST(NULL AS VARCHAR) AS fecha, CASE k % 5 WHEN 0 THEN 1234.5 WHEN 1 THEN NULL ELSE CAST(k + 0.25 AS DOUBLE) END AS total, CAST(k AS DOUBLE) AS importe_erp, CAST(NULL AS DOUBLE) AS desvio_importe, 'PAGADA' AS estado_erp, CASE k % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'EUR' END AS divisa,
  CAST(k % 3 AS VARCHAR) AS lote, 'm' || k % 2 AS metodo_lectura, CAST(NULL AS VARCHAR) AS escalon_lectura, CAST(0.5 AS DOUBLE) AS calidad_lectura, CAST(k % 4 + 0.5 AS DOUBLE) AS segundos_lectura, k % 2 = 0 AS identificacion_fiable, 'v1' AS version_norma, confirmable, CASE WHEN confirmable IS NOT NULL THEN false END AS desvio
FROM r LEFT JOIN q USING (file_id) WHERE problem IS NULL"""
)
def trace_scan(spark, sf_dir):
    rows = trace_rows.listed(_two_lots(spark, sf_dir).where("problem is null"))
    return rows.select("*", "segunda_lectura.confirmable", "segunda_lectura.desvio").drop("segunda_lectura")


@query(_LOTS + ", f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY src, k) = 1 AS head FROM r WHERE problem IS NULL) SELECT CAST(src AS INT) AS src, coalesce(problem, CASE WHEN head THEN 'primera' ELSE 'repetida' END) AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT src, problem, NULL AS head, 0 AS k FROM r WHERE problem IS NOT NULL UNION ALL SELECT src, NULL, head, k FROM f) GROUP BY 1, 2")
def trace_lines(spark, sf_dir):
    rows = _two_lots(spark, sf_dir)
    kind = F.coalesce("problem", F.when(F.col("first"), "primera").otherwise("repetida"))
    return rows.groupBy("src", kind.alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("campos")["importe_erp"].cast("long")), F.lit(0)).alias("total"))


@query(
    WORLD
    + """, l AS (SELECT k, file_id, row_number() OVER (ORDER BY k) AS num FROM invoices), named AS (SELECT num, CASE k % 19 WHEN 10 THEN upper(file_id) WHEN 11 THEN 'x_' || file_id WHEN 12 THEN (SELECT min_by(file_id, k) FROM l z WHERE z.k % 19 = 18) ELSE file_id END AS id FROM l WHERE k % 19 NOT IN (1, 2, 3, 4, 5, 9)),
names AS (SELECT file_id AS name FROM l), firsts AS (SELECT id, min(num) AS first FROM named GROUP BY 1),
p AS (SELECT unnest(CASE k % 19 WHEN 0 THEN ['aviso|termina en CRLF'] WHEN 1 THEN ['error|línea vacía'] WHEN 2 THEN ['error|no es JSON'] WHEN 3 THEN ['error|no es un objeto JSON'] WHEN 4 THEN ['error|falta file_id'] WHEN 5 THEN ['error|file_id no es un texto o está vacío'] WHEN 6 THEN ['error|falta result y aparece resultado', 'aviso|campos de más: resultado']
    WHEN 7 THEN ['error|falta result'] WHEN 8 THEN ['error|result fuera del contrato: 7', 'aviso|campos de más: a, z'] WHEN 9 THEN ['error|file_id con ruta: a/' || file_id] ELSE [] END) AS m, num FROM l
  UNION ALL SELECT 'error|' || id || ' repetido (ya en la línea ' || first || ')', num FROM named JOIN firsts USING (id) WHERE num > first
  UNION ALL SELECT 'error|' || id || CASE WHEN lower(id) IN (SELECT name FROM names) THEN ' no existe, el documento es ' || lower(id) ELSE ' no es un documento' END, num FROM named WHERE id NOT IN (SELECT name FROM names)
  UNION ALL SELECT 'error|' || name || ' sin línea', NULL FROM names WHERE name NOT IN (SELECT id FROM named))
SELECT split_part(m, '|', 1) AS severity, substr(m, strpos(m, '|') + 1) AS message, count(*) AS n, min(num) AS first FROM p GROUP BY m"""
)
def strict_contract(spark, sf_dir):
    i = World(spark, sf_dir).invoices.select("k", "file_id")
    k, f = F.col("k"), F.col("file_id")
    again = F.lit(i.where("k % 19 = 18").agg(F.min_by("file_id", "k")).first()[0])
    row = lambda name: _text('{"file_id":"', name, '","result":"PAGAR"}')
    odd = [_text(row(f), "\r"), F.lit(" "), F.lit("{x"), F.lit("[1]"), F.lit('{"result":"PAGAR"}'), F.lit('{"file_id":5,"result":"ESCALAR"}'), _text('{"file_id":"', f, '","resultado":"PAGAR"}'), _text('{"file_id":"', f, '"}'), _text('{"z":1,"file_id":"', f, '","result":7,"a":null}'), row(_text("a/", f)), row(F.upper(f)), row(_text("x_", f)), row(again)]
    lines = i.select("k", F.coalesce(F.get(F.array(*odd), (k % 19).cast("int")), row(f)).alias("line"))
    delivery = logs.numbered_lines(spark, _written(lines, "k", spark, "delivery"), across=True)
    return contract.grouped(contract.line_problems(delivery, i.select(f.alias("name"))))
