"""Whether a document's text layer can be trusted: odd characters, an inner order that isn't the order of reading, text that isn't drawn, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.evaluate import alnum, rates_of
from ledgermill.operators.tables import nearest_rank

# Least characters of a text layer, least ink of a drawn page, and the most that order and odd characters may be off.
LEAST_CHARS, LEAST_INK, MOST_ORDER, MOST_ODD = 40, 0.0005, 0.15, 0.01
# Replacement characters, private use and controls other than tab and line breaks.
ODD = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
FLAGS = ["basura", "desorden", "fantasma", "escaneo"]
BOXES = "array<struct<texto:string,left:double,bottom:double,right:double,top:double>>"


def in_reading_order(pages: DataFrame, boxes: str) -> DataFrame:
    """pages with `leidas`: its boxes (see BOXES; null: none) as structs of texto and at (the place in the inner order, from 0), in the order of reading: lines from the top, boxes of a line from the left.

    A box is on the line above it if its middle is within 0.6 heights of that line's mean. Lines are told in one pass over a page's boxes, so nothing is shuffled.
    """
    plain = f"sort_array(transform(coalesce({boxes}, array()), (b, i) -> struct(-(b.top + b.bottom) / 2 as down, i as at, greatest(b.top - b.bottom, 0.1D) as h, b.left as x, b.texto as texto)))"
    same = "s.n > 0 and abs(b.down - s.sum / s.n) <= 0.6D * greatest(b.h, s.h)"
    # Inside lambdas Spark shares no work: whether it is on the same line is found once.
    after = f"get(transform(array(coalesce({same}, false)), q -> if(q, struct(s.line as line, s.sum + b.down as sum, s.n + 1 as n, greatest(s.h, b.h) as h, concat(s.out, array(s.line)) as out), struct(s.line + 1 as line, 0D + b.down as sum, 1 as n, b.h as h, concat(s.out, array(s.line + 1)) as out))), 0)"
    start = "struct(0 as line, 0D as sum, 0 as n, 0D as h, cast(array() as array<int>) as out)"
    rows = pages.withColumn("_down", F.expr(plain)).withColumn("_line", F.expr(f"aggregate(_down, {start}, (s, b) -> {after}, s -> s.out)"))
    read = "transform(sort_array(transform(_down, (b, i) -> struct(_line[i] as line, b.x as x, b.down as down, b.at as at, b.texto as texto))), b -> struct(b.texto as texto, b.at as at))"
    return rows.withColumn("leidas", F.expr(read)).drop("_down", "_line")


def displaced(places: Column) -> Column:
    """The share of places that must move for the rest to be in order: 1 less the longest rising run of them, picked in order, as a share of all; 0 for none."""
    least = F.aggregate(places, F.array().cast("array<int>"), lambda tails, x: F.concat(F.filter(tails, lambda t: t < x), F.array(x), F.slice(F.filter(tails, lambda t: t >= x), F.lit(2), F.greatest(F.size(tails), F.lit(1)))))
    return F.when((F.size(places) == 0) | (places == F.sort_array(places)), F.lit(0.0)).otherwise(F.round(1 - F.size(least) / F.size(places), 4))


def page_measures(pages: DataFrame) -> DataFrame:
    """What is measured of each page: file_id, pagina, chars (letters and digits of its layer), weird (odd characters), order_cer (edits from the inner order to that of reading, a share of chars), order_content (the same of sorted characters: what order doesn't explain), displaced (boxes out of order), ink.

    pages: file_id, pagina, texto (the layer, in its inner order), cajas (BOXES, in that order), ink (the share of dark pixels of the drawn page). Nulls are empty, no ink is 0.
    """
    text = F.coalesce("texto", F.lit(""))
    read = F.array_join(F.transform("leidas", lambda b: b["texto"]), " ")
    some = F.trim(read) != ""  # without boxes there is no other order
    rows = in_reading_order(pages, "cajas").withColumns({"_a": alnum(text), "_b": alnum(read)}).withColumn("_r", rates_of(F.col("_a"), F.col("_b")))
    rate = lambda name: F.when(some & (F.trim(text) != ""), F.col(f"_r.{name}")).otherwise(0.0)
    return rows.select(
        "file_id",
        "pagina",
        F.col("_r.chars").alias("chars"),
        F.regexp_count(text, F.lit(ODD)).cast("long").alias("weird"),
        rate("cer").alias("order_cer"),
        rate("cer_sorted").alias("order_content"),
        displaced(F.transform("leidas", lambda b: b["at"])).alias("displaced"),
        F.coalesce("ink", F.lit(0.0)).alias("ink"),
    )


def document_flags(measures: DataFrame) -> DataFrame:
    """By document: pages, chars and weird in all, the most of ink, order_cer and displaced on a page, and flags (FLAGS, in order)."""
    c = F.col
    top = lambda name: F.max(name).alias(name)
    rows = measures.groupBy("file_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("weird").alias("weird"), top("ink"), top("order_cer"), top("displaced"))
    tests = [c("weird") / F.greatest("chars", F.lit(1)) > MOST_ODD, c("order_cer") > MOST_ORDER, (c("chars") >= LEAST_CHARS) & (c("ink") < LEAST_INK), (c("chars") < LEAST_CHARS) & (c("ink") > LEAST_INK)]
    return rows.withColumn("flags", F.array_compact(F.array(*[F.when(t, name) for name, t in zip(FLAGS, tests)])))


def layer_report(flags: DataFrame, shares: dict[str, float]) -> DataFrame:
    """name and value: documents, those with a layer, those of each flag, and of documents with a layer the ink and order_cer at each of shares (nearest rank)."""
    c = F.col
    layer = c("chars") >= LEAST_CHARS
    counts = {"documentos": F.lit(True), "con_capa": layer, "sin_capa": ~layer} | {f: F.array_contains("flags", f) for f in FLAGS}
    one = flags.agg(*[F.count_if(cond).cast("double").alias(n) for n, cond in counts.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("value")) for n in counts])).alias("x")).select("x.*")
    both = flags.where(layer).select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c(n).alias("v")) for n in ("ink", "order_cer")])).alias("x")).select("x.*")
    ranks = nearest_rank(both, "what", "v", shares)
    each = F.explode(F.array(*[F.struct(F.concat("what", F.lit(f"_{n}")).alias("name"), c(n).alias("value")) for n in shares]))
    return out.unionByName(ranks.select(each.alias("x")).select("x.*"))
