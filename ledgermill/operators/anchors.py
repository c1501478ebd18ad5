"""Where in a document's lines the values of its fields stand, misread characters allowed for.

A value is one or more tokens without separators and accents (dates in all the
ways they are written). A token of n characters may differ from the text by
no edit, one (from 6 characters) or two (from 12). If it does by k edits at
most, one of its k + 1 blocks stands in the line as it is: a document's tokens
are joined to its lines by document, and only lines that hold a block are
compared, by bounded edit distance over windows around it.

Native: DataFrame and SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.text import plain

# The least lengths of tokens and of those that may be misread, hits per field, confidences, hints by field, and months.
LEAST, LEAST_MISREAD, TWO_EDITS, MOST_HITS = 4, 6, 12, 4
WITH_HINT, WITHOUT_HINT, MISREAD = 0.95, 0.7, 0.5
HINTS = {"pedido": ["pedido", "po", "ref"], "nif": ["nif", "cif"], "iban": ["iban", "cuenta", "abono"], "fecha": ["fecha", "emision"], "base": ["base", "imponible", "subtotal"], "iva": ["iva", "cuota"], "total": ["total"]}
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def bare(text: Column) -> Column:
    """Small letters and digits alone, without accents."""
    return F.regexp_replace(plain(text), "[^0-9a-z]+", "")


def tokens(field: Column, value: Column) -> Column:
    """What to look for: the value itself, or an ISO date in its ways of writing, in order; at least LEAST characters each."""
    iso = r"^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})\s*$"
    y, m, d = (F.regexp_extract(value, iso, g) for g in (1, 2, 3))
    short = lambda x: F.regexp_replace(x, "^0", "")
    name = F.get(F.array(*map(F.lit, MONTHS)), m.try_cast("int") - 1)
    de = F.lit("de")
    ways = [F.concat(y, m, d), F.concat(d, m, y), F.concat(short(d), m, y), F.concat(d, short(m), y), F.concat(short(d), short(m), y), F.concat(short(d), de, name, de, y), F.concat(d, de, name, de, y), F.concat(short(d), de, F.substring(name, 1, 3), de, y)]
    dates = F.array_sort(F.array_distinct(F.array_compact(F.array(*ways))))
    found = F.when((field == "fecha") & value.rlike(iso), dates).otherwise(F.array_compact(F.array(bare(value))))
    return F.filter(found, lambda t: F.length(t) >= LEAST)


#: Edits of the best window of line `plano` that is like `t.token`, around any of its blocks; null if there is none.
_EDITS = """if(contains(plano, t.token), 0, array_min(flatten(transform(t.blocks, b -> flatten(transform(
  filter(sequence(1, greatest(length(plano), 1)), p -> substr(plano, p, length(b.text)) = b.text),
  p -> flatten(transform(sequence(-t.allowed, t.allowed), s -> transform(sequence(-1, 1), w ->
    if(p - b.at + s < 1 or p - b.at + s + length(t.token) + w - 1 > length(plano), null, nullif(levenshtein(t.token, substr(plano, p - b.at + s, length(t.token) + w), t.allowed), -1)))))))))))"""


def anchors(values: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, campo, pagina, num, texto, edits and confianza of the lines where a field's value stands: of its tokens the one found with most confidence (the first of these), its first MOST_HITS lines.

    values: file_id, campo, valor. lines: file_id, pagina, num, texto. Null and short values have no token; other columns are not read.
    """
    c = F.col
    # A document's tokens, each with its blocks, are an array that meets its lines one by one: no piece of a line is shuffled.
    own = values.where("campo is not null").select("file_id", "campo", F.array_distinct(tokens(c("campo"), c("valor"))).alias("ts"))
    sought = own.where(F.size("ts") > 0).groupBy("file_id").agg(F.collect_set(F.struct("campo", "ts")).alias("all"))
    each = "array_distinct(flatten(transform(all, v -> transform(v.ts, (x, i) -> named_struct('campo', v.campo, 'nth', i, 'token', x)))))"
    allowed = f"named_struct('campo', x.campo, 'nth', x.nth, 'token', x.token, 'allowed', case when length(x.token) < {LEAST_MISREAD} then 0 when length(x.token) < {TWO_EDITS} then 1 else 2 end)"
    cut = "greatest(1, length(x.token) div (x.allowed + 1))"
    block = f"named_struct('at', cast(i * {cut} as int), 'text', if(i = x.allowed, substr(x.token, i * {cut} + 1), substr(x.token, i * {cut} + 1, {cut})))"
    blocks = f"named_struct('campo', x.campo, 'nth', x.nth, 'token', x.token, 'allowed', x.allowed, 'blocks', transform(sequence(0, x.allowed), i -> {block}))"
    sought = sought.select("file_id", F.expr(f"transform(transform({each}, x -> {allowed}), x -> {blocks})").alias("sought"))
    read = lines.where("pagina is not null and num is not null").select("file_id", "pagina", "num", "texto", bare(c("texto")).alias("plano"))
    near = "filter(sought, t -> exists(t.blocks, b -> contains(plano, b.text)))"
    found = f"filter(transform({near}, t -> named_struct('campo', t.campo, 'nth', t.nth, 'edits', {_EDITS})), h -> h.edits is not null)"
    hits = read.join(sought, "file_id").select("file_id", "pagina", "num", "texto", "plano", F.expr(f"inline({found})"))
    hint = F.lit(False)
    for name, words in HINTS.items():
        hint = hint | ((c("campo") == name) & c("plano").rlike("|".join(words)))
    hits = hits.withColumn("confianza", F.when(c("edits") > 0, MISREAD).when(hint, WITH_HINT).otherwise(WITHOUT_HINT))
    first = hits.withColumn("_n", F.expr("row_number() over (partition by file_id, campo, nth order by pagina, num)")).where(c("_n") <= MOST_HITS)
    best = F.expr("max_by(nth, struct(confianza, -nth)) over (partition by file_id, campo)")
    return first.withColumn("_best", best).where("nth = _best").select("file_id", "campo", "pagina", "num", "texto", "edits", "confianza")
