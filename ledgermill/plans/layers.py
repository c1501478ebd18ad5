"""Registered queries of text layers: order lines as boxes on pages, some of them moved, spoiled or not drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import textlayer
from ledgermill.plans.catalog import _t, query

_SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p100": 1.0}


def _pages(spark, sf_dir) -> DataFrame:
    """A document an order, a page four lines, two boxes a line (left: part and date; right: amount), in one of three inner orders."""
    c, lit = F.col, F.lit
    li = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").cast("int").alias("n"), c("l_partkey").alias("part"), "l_shipdate", "l_extendedprice")
    k, three = c("k"), lambda *x: F.array(*[v.cast("long") for v in x])

    def two(x):
        """The boxes of a line, with their places. A line's second box hangs a little lower; it is on the line all the same."""
        day, price = F.date_format(x["l_shipdate"], "yyyy-MM-dd"), x["l_extendedprice"].cast("decimal(18,2)").cast("string")
        texts = [F.concat_ws(" ", lit("pieza"), x["part"].cast("string"), day), F.concat(lit("importe "), price, F.when(k % 11 == 0, "\ue000\ufffd").otherwise(""))]

        def box(col):
            top = (lit(800) - x["n"] * 20 - col * 3).cast("double")
            place = F.when(k % 5 == 0, three(x["part"], x["n"], lit(col))).when(k % 7 == 0, three(lit(col), x["n"], lit(0))).otherwise(three(x["n"], lit(col), lit(0)))
            return F.struct(place.alias("at"), F.struct(texts[col].alias("texto"), lit(10.0 + col * 200).alias("left"), (top - 10).alias("bottom"), lit(150.0 + col * 200).alias("right"), top.alias("top")).alias("box"))

        return F.array(box(0), box(1))

    # Lines are gathered as they are in the table; boxes are made in their page's row.
    lines = li.groupBy("k", F.when(c("n") > 4, 2).otherwise(1).alias("pagina")).agg(F.collect_list(F.struct("n", "part", "l_shipdate", "l_extendedprice")).alias("lines"))
    pages = lines.select("k", "pagina", F.transform(F.sort_array(F.flatten(F.transform("lines", two))), lambda x: x["box"]).alias("cajas"))
    scan = k % 17 == 0
    return pages.select(
        F.concat(lit("doc_"), k.cast("string")).alias("file_id"),
        "pagina",
        F.when(~scan, F.array_join(F.transform("cajas", lambda b: b["texto"]), "\n")).alias("texto"),
        F.when(~scan, c("cajas")).alias("cajas"),
        F.when(k % 13 != 0, (k % 100 + 1) / 1000.0).alias("ink"),
    )


_MEASURES = """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS part, col, CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS pagina, CASE col WHEN 0 THEN 'pieza ' || l_partkey || ' ' || strftime(l_shipdate, '%Y-%m-%d') ELSE 'importe ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN l_orderkey % 11 = 0 THEN chr(57344) || chr(65533) ELSE '' END END AS t
  FROM lineitem, (VALUES (0), (1)) v(col)),
p AS (SELECT *, CASE WHEN k % 5 = 0 THEN [part, n, col] WHEN k % 7 = 0 THEN [col, n, 0] ELSE [n, col, 0] END AS place FROM b), i AS (SELECT *, row_number() OVER (PARTITION BY k, pagina ORDER BY place, t) AS pos FROM p),
g AS (SELECT k, pagina, string_agg(t, ' ' ORDER BY pos) AS inner_, string_agg(t, ' ' ORDER BY n, col, pos) AS reading, list([pos] ORDER BY n, col, pos) AS ats FROM i GROUP BY 1, 2),
x AS (SELECT *, k % 17 = 0 AS scan, regexp_replace(lower(inner_), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(reading), '[^a-z0-9]', '', 'g') AS b FROM g),
m AS (SELECT 'doc_' || k AS file_id, pagina, CAST(CASE WHEN scan THEN 0 ELSE length(a) END AS BIGINT) AS chars, CAST(CASE WHEN scan THEN 0 ELSE length(inner_) - length(replace(replace(inner_, chr(57344), ''), chr(65533), '')) END AS BIGINT) AS weird, CASE WHEN scan THEN 0.0::DOUBLE ELSE round(levenshtein(a, b) / length(a), 4) END AS order_cer, 0.0::DOUBLE AS order_content,
  CASE WHEN scan THEN 0.0::DOUBLE ELSE round(1 - len(list_reduce(ats, lambda s, v: list_concat(list_filter(s, lambda t: t < v[1]), v, list_filter(s, lambda t: t >= v[1])[2:]))) / len(ats), 4) END AS displaced, CASE WHEN k % 13 <> 0 THEN (k % 100 + 1) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS ink FROM x),
f AS (SELECT file_id, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(weird) AS BIGINT) AS weird, max(ink) AS ink, max(order_cer) AS order_cer, max(displaced) AS displaced FROM m GROUP BY 1),
flagged AS (SELECT *, concat_ws(',', CASE WHEN weird / greatest(chars, 1) > 0.01 THEN 'basura' END, CASE WHEN order_cer > 0.15 THEN 'desorden' END, CASE WHEN chars >= 40 AND ink < 0.0005 THEN 'fantasma' END, CASE WHEN chars < 40 AND ink > 0.0005 THEN 'escaneo' END) AS flags FROM f)
"""


@query(_MEASURES + "SELECT file_id, CAST(pagina AS INT) AS pagina, chars, weird, order_cer, order_content, displaced, ink FROM m")
def text_layer_pages(spark, sf_dir):
    return textlayer.page_measures(_pages(spark, sf_dir))


@query(_MEASURES + "SELECT file_id, pages, chars, weird, ink, order_cer, displaced, flags FROM flagged")
def text_layer_flags(spark, sf_dir):
    return textlayer.document_flags(textlayer.page_measures(_pages(spark, sf_dir))).withColumn("flags", F.array_join("flags", ","))


@query(
    _MEASURES
    + """, r AS (SELECT what, v, row_number() OVER (PARTITION BY what ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY what) AS n FROM (SELECT 'ink' AS what, ink AS v FROM flagged WHERE chars >= 40 UNION ALL SELECT 'order_cer', order_cer FROM flagged WHERE chars >= 40))
SELECT what || '_' || p AS name, v AS value FROM r, (VALUES ('p0', 0.0), ('p25', 0.25), ('p50', 0.5), ('p100', 1.0)) s(p, share) WHERE i = CAST(round_even(share * (n - 1), 0) AS BIGINT)
UNION ALL SELECT unnest(['documentos', 'con_capa', 'sin_capa', 'basura', 'desorden', 'fantasma', 'escaneo']), unnest([count(*), count(*) FILTER (chars >= 40), count(*) FILTER (chars < 40), count(*) FILTER (contains(flags, 'basura')), count(*) FILTER (contains(flags, 'desorden')), count(*) FILTER (contains(flags, 'fantasma')), count(*) FILTER (contains(flags, 'escaneo'))])::DOUBLE FROM flagged"""
)
def text_layer_report(spark, sf_dir):
    return textlayer.layer_report(textlayer.document_flags(textlayer.page_measures(_pages(spark, sf_dir))), _SHARES)
