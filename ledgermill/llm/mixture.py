"""Mixing sources to target weights, cut at each source's exact budget.

Sources, in code point order and null last, have weights that repeat, and
share a total by them. A source's share stops at `epochs` times its size; what
is over goes to the others by weight until none is above (fill_up). Then every
document has a key from a hash of its number. Within its source, documents
stand in the order of their keys; a source that is to give e whole epochs and
r words more takes every document e times and, once more, the documents before
the place where the prefix sum of sizes reaches r; the one at that place gives
just the words that are missing.

Keys spread evenly, so that ranges of a source are ranges of equal width of
the key: as many as its documents need, whatever share of all rows it has. A
range is summed up in one task, ranges by their totals (ranges.with_sums_before).
No sampling, no order of rows and no partitioning has a say, so reruns agree.

Native: DataFrame functions alone.

Defined cases: null text has size 0 and is taken 0 times; a null source is a
source of its own; rows that repeat a doc_id stand side by side, by size; equal rows are
interchangeable; if all sizes are 0, so are all targets; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, stored
from ledgermill.llm.ranges import RANGE_ROWS, ranked, with_sums_before

#: Hexadecimal digits of a key: whole numbers under 2**52.
DIGITS = 13


def key(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def fill_up(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """source, n, source_size and target of each source (source, n, source_size): the total shared by weight, with targets of at most `epochs` times the size.

    Every round the sources above their stop are set to it and the rest is shared anew; what is left is summed up by aggregates, so that there may be any number of sources.
    """
    order = [F.asc_nulls_last("source")]
    place = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked(sources, order, "place").select("source", "n", "source_size", place.cast("long").alias("w"), (F.col("source_size") * epochs).alias("stop"))
    rows = stored(rows)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    # A source is above its stop if rest * w > stop * all_w; exact in decimals. Those that stopped stay so, as the level only rises.
    above = lambda rest, w: F.lit(rest).cast("decimal(19,0)") * F.col("w") > F.col("stop").cast("decimal(19,0)") * F.lit(w)
    rest, all_w = total, rows.agg(F.sum("w")).first()[0] or 1
    while True:
        over = above(rest, all_w)
        kept = rows.agg(F.sum(F.when(over, F.col("stop")).otherwise(0)).alias("stop"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w")).first()
        after = (total - (kept["stop"] or 0), kept["w"] or 0)
        if after == (rest, all_w) or not after[1]:
            break
        rest, all_w = after
    share = F.when(above(rest, all_w), F.col("stop").cast("double")).otherwise(F.lit(float(rest)) * F.col("w") / F.lit(float(all_w)))
    return rows.select("source", "n", "source_size", share.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 13) -> DataFrame:
    """doc_id, size (words), source_size, target (its source's) and taken (words the mix takes of it) of every document."""
    rows = stored(sizes(docs))
    shares = stored(fill_up(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, epochs))
    right = bounded(shares.withColumnRenamed("source", "of"), BROADCAST_ROWS)
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    rows = rows.join(right, F.col("source").eqNullSafe(F.col("of"))).withColumn("key", key(F.col("doc_id"), seed)).withColumn("range", F.floor(F.col("key") / F.lit(float(16**DIGITS)) * ranges).cast("long"))
    placed = with_sums_before(rows.drop("of", "n"), "size", [F.asc("key"), F.asc_nulls_last("doc_id"), F.asc("size")], ["range"], ["source"], "before")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs).cast("long"), F.expr("floor(target) div greatest(source_size, 1)"))).otherwise(F.lit(0))
    more = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), more - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
