"""Registered queries over what documents say: extraction by lines, anchors, and scores of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import evaluate
from ledgermill.operators import anchors, ladder, lines, reports
from ledgermill.plans.catalog import query
from ledgermill.plans.world import SQL as WORLD
from ledgermill.plans.world import World


def _comma(x):
    return F.replace(x.cast("string"), F.lit("."), F.lit(","))


@query(
    WORLD
    + """, x AS (SELECT i.k, i.file_id, o.po, i.base, o.nif, o.d FROM invoices i JOIN inv0 o USING (k))
SELECT file_id, CASE k % 5 WHEN 4 THEN 'ILEGIBLE' ELSE 'ENCONTRADO' END AS nif_estado, CASE WHEN k % 5 <> 4 THEN nif END AS nif, CASE WHEN k % 3 = 0 THEN 'NO_APARECE' ELSE 'ENCONTRADO' END AS cliente_estado, CASE WHEN k % 3 <> 0 THEN 'A58231074' END AS cif_cliente, replace(po, '/', '-') AS pedido, 'F-' || k AS numero,
  CASE WHEN k % 7 = 0 THEN 'ILEGIBLE' ELSE 'ENCONTRADO' END AS fecha_estado, CASE WHEN k % 7 <> 0 THEN strftime(d, '%Y-%m-%d') END AS fecha, CAST(base AS VARCHAR) AS base,
  CASE k % 4 WHEN 2 THEN 'ILEGIBLE' WHEN 3 THEN 'NO_APARECE' ELSE 'ENCONTRADO' END AS total_estado, CASE WHEN k % 4 < 2 THEN CAST(base AS VARCHAR) END AS total FROM x"""
)
def legacy_lines(spark, sf_dir):
    w, c, lit, k = World(spark, sf_dir), F.col, F.lit, F.col("k")
    i = w.invoices.select("k", "file_id", "base").join(w.truth.select("k", "po", "nif", "d"), "k")
    money = _comma(c("base"))
    # A total on its label's line, on the next one, before and after others, or negative.
    total = (
        F.when(k % 4 == 0, F.concat(lit("TOTAL 1,00\nTOTAL A PAGAR .....\nEUR "), money, lit("\nTOTAL 7,00")))
        .when(k % 4 == 1, F.concat(lit("Total factura 5,00\nSUBTOTAL 9,00\nIMPORTE TOTAL: "), money, lit(" €\nTOTAL BASE 3,00")))
        .when(k % 4 == 2, F.concat(lit("SUBTOTAL 9,00\nTOTAL (", ), money, lit(")")))
        .otherwise("importe pendiente 12,00")
    )
    # Within three lines of the client's label, or one further on.
    client = F.when(k % 3 == 0, "Cliente: ACME\nCalle Mayor\nMadrid\nEspaña\nA58231074").otherwise("Facturar a ACME\nCalle Mayor\nCIF: A58231074")
    nif = F.when(k % 5 == 4, "NIF: ilegible").otherwise(F.concat(lit("N.I.F. / CIF: "), "nif"))
    text = F.concat_ws("\n", nif, F.concat(lit("Factura Nº F-"), k.cast("string")), F.when(k % 7 == 0, "Fecha 31/04/2026").otherwise(F.concat(lit("FECHA: "), F.date_format("d", "dd/MM/yyyy"))), F.concat(lit("Ref "), F.replace("po", lit("-2026-"), lit("-2026/"))), client, F.concat(lit("Base imponible\n"), money), total)
    f = lines.fields(i.select("file_id", text.alias("texto")))
    v = lambda name: c(f"{name}.valor").alias(name)
    return f.select("file_id", c("nif.estado").alias("nif_estado"), v("nif"), c("cif_cliente.estado").alias("cliente_estado"), v("cif_cliente"), v("pedido"), v("numero"), c("fecha.estado").alias("fecha_estado"), v("fecha"), v("base"), c("total.estado").alias("total_estado"), v("total"))


def _pages(w: World) -> tuple[DataFrame, DataFrame]:
    """Values of invoices, and lines in which they stand: as they are, misread, without a label, or several times."""
    c, lit, k = F.col, F.lit, F.col("k")
    i = w.invoices.select("k", "file_id").join(w.truth.select("k", "po", "nif", "iban", "d"), "k")
    entry = lambda name, value: F.struct(lit(name).alias("campo"), value.alias("valor"))
    values = i.select("file_id", F.inline(F.array(entry("pedido", c("po")), entry("nif", F.lower("nif")), entry("iban", c("iban")), entry("fecha", F.date_format("d", "yyyy-MM-dd")), entry("total", lit("12")))))
    months = F.array(*map(lit, anchors.MONTHS))
    written = F.when(k % 3 == 0, F.date_format("d", "dd/MM/yyyy")).when(k % 3 == 1, F.concat(F.dayofmonth("d").cast("string"), lit(" de "), F.get(months, F.month("d") - 1), lit(" de "), F.year("d").cast("string"))).otherwise(F.date_format("d", "yyyy.MM.dd"))
    order = F.when(k % 5 == 0, F.replace("po", lit("PO"), lit("PD"))).when(k % 5 == 1, F.replace("po", lit("-20"), lit("-"))).otherwise(c("po"))
    iban = F.when(k % 4 == 0, F.regexp_replace("iban", "^ES(.)(.)", "ES$2 $1")).when(k % 4 == 1, F.regexp_replace("iban", "(...)$", "X")).otherwise(F.regexp_replace("iban", "(....)", "$1 "))
    texts = [F.concat(F.when(k % 2 == 0, "Pedido: ").otherwise(""), order), F.concat(lit("N.I.F. "), "nif"), F.concat(lit("Abono en "), iban), F.concat(lit("Fecha de emisión "), written), F.when(k % 7 == 0, F.concat_ws(" ", "nif", "po", "nif")).otherwise("Gracias")]
    page = i.select("file_id", F.posexplode(F.array(*texts)).alias("num", "texto"))
    return values, page.select("file_id", F.floor(c("num") / 3).cast("int").alias("pagina"), "num", "texto")


_BARE = "regexp_replace(lower(translate({}, 'óñ', 'on')), '[^0-9a-z]', '', 'g')"
_MONTHS = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"


@query(
    WORLD
    + f""", x AS (SELECT i.k, i.file_id, o.po, o.nif, o.iban, o.d, day(o.d) AS dd, month(o.d) AS mm, year(o.d) AS yy FROM invoices i JOIN inv0 o USING (k)),
ln AS (SELECT file_id, num // 3 AS pagina, num, texto, {_BARE.format('texto')} AS plano FROM (SELECT file_id, unnest([0, 1, 2, 3, 4]) AS num, unnest([CASE WHEN k % 2 = 0 THEN 'Pedido: ' ELSE '' END || CASE k % 5 WHEN 0 THEN replace(po, 'PO', 'PD') WHEN 1 THEN replace(po, '-20', '-') ELSE po END, 'N.I.F. ' || nif,
  'Abono en ' || CASE k % 4 WHEN 0 THEN regexp_replace(iban, '^ES(.)(.)', 'ES\\2 \\1') WHEN 1 THEN regexp_replace(iban, '(...)$', 'X') ELSE regexp_replace(iban, '(....)', '\\1 ', 'g') END,
  'Fecha de emisión ' || CASE k % 3 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN dd || ' de ' || {_MONTHS}[mm] || ' de ' || yy ELSE strftime(d, '%Y.%m.%d') END, CASE WHEN k % 7 = 0 THEN nif || ' ' || po || ' ' || nif ELSE 'Gracias' END]) AS texto FROM x)),
tk AS (SELECT DISTINCT file_id, campo, unnest(list_sort(t)) AS token, unnest(range(len(t))) AS nth FROM (SELECT file_id, 'pedido' AS campo, [{_BARE.format('po')}] AS t FROM x UNION ALL SELECT file_id, 'nif', [lower(nif)] FROM x UNION ALL SELECT file_id, 'iban', [lower(iban)] FROM x
  UNION ALL SELECT file_id, 'fecha', list_distinct([strftime(d, '%Y%m%d'), strftime(d, '%d%m%Y'), dd || strftime(d, '%m%Y'), strftime(d, '%d') || mm || yy, CAST(dd AS VARCHAR) || mm || yy, dd || 'de' || {_MONTHS}[mm] || 'de' || yy, strftime(d, '%d') || 'de' || {_MONTHS}[mm] || 'de' || yy, dd || 'de' || left({_MONTHS}[mm], 3) || 'de' || yy]) FROM x)),
-- Every token with every window of every line.
al AS (SELECT *, CASE WHEN length(token) < 12 THEN 1 ELSE 2 END AS allowed FROM tk JOIN ln USING (file_id)),
ed AS (SELECT *, CASE WHEN contains(plano, token) THEN 0 ELSE list_min(list_filter(list_transform(flatten(list_transform([-1, 0, 1], lambda w: list_transform(range(1, greatest(length(plano) - length(token) - w + 2, 1)), lambda s: substr(plano, s, length(token) + w)))), lambda z: levenshtein(token, z)), lambda e: e <= allowed)) END AS edits FROM al),
hit AS (SELECT *, CASE WHEN edits > 0 THEN 0.5 WHEN regexp_matches(plano, CASE campo WHEN 'pedido' THEN 'pedido|po|ref' WHEN 'nif' THEN 'nif|cif' WHEN 'iban' THEN 'iban|cuenta|abono' ELSE 'fecha|emision' END) THEN 0.95 ELSE 0.7 END AS confianza, row_number() OVER (PARTITION BY file_id, campo, nth ORDER BY pagina, num) AS n FROM ed WHERE edits IS NOT NULL),
top AS (SELECT file_id, campo, arg_max(nth, (confianza, -nth)) AS nth FROM hit WHERE n <= 4 GROUP BY 1, 2)
SELECT file_id, campo, CAST(pagina AS INTEGER) AS pagina, num, texto, edits, CAST(confianza AS DOUBLE) AS confianza FROM hit JOIN top USING (file_id, campo, nth) WHERE n <= 4"""
)
def anchor_search(spark, sf_dir):
    return anchors.anchors(*_pages(World(spark, sf_dir)))


@query(
    WORLD
    + """, x AS (SELECT i.k, i.file_id, o.nif, o.iban, strftime(o.d, '%d/%m/%Y') AS f, 1000 + i.k % 9000 AS m FROM invoices i JOIN inv0 o USING (k)),
p AS (SELECT k, file_id, 0 AS page, nif || ' ' || iban AS t, CASE k % 4 WHEN 0 THEN nif WHEN 1 THEN left(nif, 8) || 'I' WHEN 2 THEN 'X9999999Y ' || nif ELSE '' END || ' ' || CASE WHEN k % 3 = 0 THEN '' ELSE iban END AS g FROM x
  UNION ALL SELECT k, file_id, 1, CASE WHEN k % 5 = 0 THEN '' ELSE 'Fecha ' || f || ' Total ' || m || ',50' END, CASE WHEN k % 7 = 0 THEN 'Total ' || m || ',50 Fecha ' || f ELSE 'Fecha ' || f || ' Total 1,11' END FROM x),
bare AS (SELECT *, regexp_replace(lower(t), '[^0-9a-z]', '', 'g') AS a, regexp_replace(lower(g), '[^0-9a-z]', '', 'g') AS b FROM p),
c AS (SELECT *, length(a) AS chars, CASE WHEN a = '' THEN 0 ELSE round(levenshtein(a, b) / length(a), 4) END AS cer, CASE WHEN a = '' THEN 0 ELSE round(levenshtein(array_to_string(list_sort(string_split(a, '')), ''), array_to_string(list_sort(string_split(b, '')), '')) / length(a), 4) END AS cer_s FROM bare),
-- By page: true values, those that are read, what is read where there are any, and what of it is true or like it.
scored AS (SELECT *, CASE WHEN page = 0 THEN 2 WHEN k % 5 = 0 THEN 0 ELSE 2 END AS checked,
  CASE WHEN page = 0 THEN CASE WHEN k % 4 IN (0, 2) THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS hits,
  CASE WHEN page = 0 THEN CASE k % 4 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END WHEN k % 5 = 0 THEN 0 ELSE 2 END AS produced,
  CASE WHEN page = 0 THEN CASE k % 4 WHEN 3 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS truly FROM c),
d AS (SELECT k, file_id, sum(chars) AS chars, round(sum(cer * chars) / sum(chars), 4) AS cer, round(sum(cer_s * chars) / sum(chars), 4) AS cer_sorted, sum(checked) AS checked, sum(produced) AS produced, round(sum(hits) / sum(checked), 4) AS recall, round(sum(truly) / nullif(sum(produced), 0), 4) AS precision FROM scored GROUP BY 1, 2)
SELECT file_id, CAST(chars AS BIGINT) AS chars, cer, cer_sorted, CAST(checked AS BIGINT) AS checked, CAST(produced AS BIGINT) AS produced, recall, precision, CASE WHEN recall + precision = 0 THEN 0 ELSE round(2 * recall * precision / (recall + precision), 4) END AS f1,
  array_to_string(list_sort(list_filter([CASE WHEN k % 4 IN (1, 3) THEN 'nif:' || nif END, CASE WHEN k % 3 = 0 THEN 'iban:' || iban END, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 'importes:' || m || '.50' END], lambda v: v IS NOT NULL)), ' ') AS missing FROM d JOIN x USING (k, file_id)"""
)
def weighted_error_and_f1(spark, sf_dir):
    w, c, lit, k = World(spark, sf_dir), F.col, F.lit, F.col("k")
    i = w.invoices.select("k", "file_id").join(w.truth.select("k", "nif", "iban", F.date_format("d", "dd/MM/yyyy").alias("f")), "k").withColumn("m", F.concat((1000 + k % 9000).cast("string"), lit(",50")))
    nif = F.when(k % 4 == 0, c("nif")).when(k % 4 == 1, F.concat(F.substring("nif", 1, 8), lit("I"))).when(k % 4 == 2, F.concat(lit("X9999999Y "), "nif")).otherwise("")
    page = lambda n, t, g: F.struct(lit(n).alias("page"), t.alias("truth"), g.alias("guess"))
    first = page(0, F.concat_ws(" ", "nif", "iban"), F.concat_ws(" ", nif, F.when(k % 3 == 0, "").otherwise(c("iban"))))
    right = F.concat(lit("Fecha "), "f", lit(" Total "), "m")
    second = page(1, F.when(k % 5 == 0, "").otherwise(right), F.when(k % 7 == 0, F.concat(lit("Total "), "m", lit(" Fecha "), "f")).otherwise(F.concat(lit("Fecha "), "f", lit(" Total 1,11"))))
    return reports.reading_scores(i.select("file_id", F.inline(F.array(first, second)))).withColumn("missing", F.array_join("missing", " "))


@query(
    WORLD
    + """, x AS (SELECT k, file_id, (k % 10) / 10.0 AS q, CASE WHEN k % 3 = 0 THEN 'cache ' || k END AS cache, CASE WHEN k % 7 <> 0 THEN 'local ' || k END AS local, (k % 11) / 11.0 AS ql, k % 13 = 0 AS bad, CASE WHEN k % 17 <> 0 THEN 'nube ' || k END AS nube, (k % 5) / 5.0 AS qn FROM invoices),
y AS (SELECT *, CASE WHEN local IS NULL THEN 0 ELSE ql END AS q0, q < 0.6 AND cache IS NULL AND (local IS NULL OR ql < 0.6 OR bad) AS weak FROM x),
z AS (SELECT *, CASE WHEN weak THEN row_number() OVER (PARTITION BY weak ORDER BY k) END AS place FROM y), v AS (SELECT *, coalesce(place <= 250, false) AS asked, coalesce(place <= 250, false) AND nube IS NOT NULL AND qn > q0 AS better FROM z)
SELECT file_id, CASE WHEN q >= 0.6 THEN 'capa_texto' WHEN cache IS NOT NULL THEN 'cache_ocr' WHEN better THEN 'vision_nube' WHEN local IS NULL THEN 'degradado' ELSE 'vision_ocr' END AS escalon, CASE WHEN q >= 0.6 THEN 'capa ' || k WHEN cache IS NOT NULL THEN cache WHEN better THEN nube ELSE coalesce(local, '') END AS texto,
  CASE WHEN q >= 0.6 OR cache IS NOT NULL THEN q WHEN better THEN greatest(q, qn) WHEN local IS NULL THEN q ELSE greatest(q, q0) END AS calidad, CASE WHEN better OR NOT weak THEN '' WHEN NOT asked THEN 'presupuesto agotado' WHEN nube IS NULL THEN 'sin respuesta' ELSE 'sin mejora' END AS error FROM v"""
)
def reading_ladder(spark, sf_dir):
    k, c = F.col("k"), F.col
    named = lambda x: F.concat(F.lit(f"{x} "), k.cast("string"))
    rows = World(spark, sf_dir).invoices.select("file_id", k.alias("seq"), named("capa").alias("capa"), (k % 10 / 10).alias("q_capa"), F.when(k % 3 == 0, named("cache")).alias("cache"), F.when(k % 7 != 0, named("local")).alias("local"), (k % 11 / 11).alias("q_local"), (k % 13 == 0).alias("ilegible"), F.when(k % 17 != 0, named("nube")).alias("nube"), (k % 5 / 5).alias("q_nube"))
    return ladder.ladder(rows, 250).select("file_id", "escalon", "texto", c("calidad").cast("double").alias("calidad"), "error")


@query(
    WORLD
    + """, x AS (SELECT k, file_id, po, CAST(base AS VARCHAR) AS b FROM invoices JOIN (SELECT k, po FROM inv0) USING (k))
SELECT file_id, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'zzz' || k || 'zzz' END, CASE WHEN k % 4 = 0 THEN 'Gracias por su visita' END], lambda l: l IS NOT NULL), '|') AS solo_a, CASE WHEN k % 5 = 0 THEN 'WWWW QQQQ WWWW' ELSE '' END AS solo_b FROM x"""
)
def exclusive_lines(spark, sf_dir):
    w, lit, k = World(spark, sf_dir), F.lit, F.col("k")
    i = w.invoices.select("k", "file_id", F.col("base").cast("string").alias("b")).join(w.truth.select("k", "po"), "k")
    # Both have order and amount: misread, on one line or two, with other punctuation.
    a = F.concat_ws("\n", F.concat(lit(" Pedido "), "po"), F.concat(lit("Servicio mensual "), "b"), F.when(k % 3 == 0, F.concat(lit("zzz"), k.cast("string"), lit("zzz"))), F.when(k % 4 == 0, lit("Gracias por su visita")), lit("--"))
    # No amount has a line of its own: of some keys the planted line of digits would be like it.
    b = F.concat_ws("\r\n", F.concat(lit("Pedldo: "), "po"), lit("Servicio"), F.concat(lit("mensual "), F.replace("b", lit("."), lit(","))), F.when(k % 5 == 0, lit("WWWW QQQQ WWWW")))
    both = i.select("file_id", a.alias("a"), b.alias("b"))
    return both.select("file_id", F.array_join(evaluate.only_in(F.col("a"), F.col("b")), "|").alias("solo_a"), F.array_join(evaluate.only_in(F.col("b"), F.col("a")), "|").alias("solo_b"))
