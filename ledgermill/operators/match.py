"""Joins on identifiers: exact, repaired, bounded-fuzzy, unique and band."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row")).select(key, "_row.*")


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once, without a window over a frequent key."""
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row")).where("_n = 1")
    return once.select(*keys, "_row.*")


def strict_or_repaired(rows: DataFrame, column: str, vocabulary: DataFrame, word: str, repair) -> DataFrame:
    """rows with `matched` and `via`: the vocabulary's word that column equals, or else that its repaired form equals; null if there is none."""
    words = vocabulary.select(F.col(word).alias("_word")).distinct()
    exact = rows.join(words, rows[column] == words["_word"], "left").withColumnRenamed("_word", "_exact")
    again = words.withColumnRenamed("_word", "_again")
    both = exact.join(again, F.col("_exact").isNull() & (repair(F.col(column)) == F.col("_again")), "left")
    via = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_again").isNotNull(), "repaired")
    return both.select(*rows.columns, F.coalesce("_exact", "_again").alias("matched"), via.alias("via"))


def fuzzy_same_length(rows: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """rows with `matched`: the vocabulary's word that column equals, or else the first in order of those that differ in one place; null if there is none.

    Rows without an equal word meet words by what is left of both with one place masked, so that only true neighbours meet.
    """
    words = vocabulary.select(F.col(word).alias("_word")).where(F.col(word).isNotNull()).distinct()
    keys = rows.select(column).where(F.col(column).isNotNull()).distinct()
    equal = keys.join(words, F.col(column) == F.col("_word")).select(column, F.col("_word").alias("matched"))

    def masked(c: Column) -> Column:
        cut = lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("\x00"), F.substr(c, i + 1, F.length(c) - i))
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), cut))

    some = lambda c: F.length(c) > 0
    rest = keys.join(equal, column, "left_anti").where(some(F.col(column)))
    met = rest.withColumn("_mask", masked(F.col(column))).join(words.where(some(F.col("_word"))).withColumn("_mask", masked(F.col("_word"))), "_mask")
    best = equal.unionByName(met.groupBy(column).agg(F.min("_word").alias("matched")))
    return rows.join(best, column, "left").select(*rows.columns, "matched")


def guarded(rows: DataFrame, column: str, vocabulary: DataFrame, word: str, repair, theta: float) -> DataFrame:
    """rows with `matched` and `via`: exact, repaired, or else `fuzzy`, the most similar word of equal length with similarity of theta or more (ties: the first in order).

    Two words of n characters that are within k edits agree in one of k + 1 parts, shifted by at most k: rows meet words by part and shift. Common parts at either end say little where all words begin alike, so parts are cut from the middle that isn't common to the whole vocabulary.
    """
    strict = strict_or_repaired(rows, column, vocabulary, word, repair)
    words = vocabulary.select(F.col(word).alias("_word")).where(F.col(word).isNotNull()).distinct().withColumn("_n", F.length("_word"))
    least, most = words.agg(F.min("_word"), F.max("_word")).first()  # a common beginning of both is common to all
    head = len(os.path.commonprefix([least or "", most or ""]))
    keys = strict.where(F.col("matched").isNull() & F.col(column).isNotNull()).select(column).distinct().withColumn("_n", F.length(column))
    edits = F.floor(F.lit(1 - theta + 1e-9) * F.col("_n")).cast("int")

    def part(c: Column, shifts: bool) -> Column:
        size = F.greatest(F.lit(1), F.floor((F.col("_n") - head) / (edits + 1)).cast("int"))
        cut = lambda i, by: F.concat_ws(":", i.cast("string"), F.col("_n").cast("string"), F.substr(c, F.lit(head + 1) + i * size + by, size))
        places = F.sequence(F.lit(0), edits)
        if not shifts:
            return F.transform(places, lambda i: cut(i, F.lit(0)))
        return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(-edits, edits), lambda by: cut(i, by))))

    met = keys.withColumn("_part", F.explode(F.array_distinct(part(F.col(column), True)))).join(words.withColumn("_part", F.explode(part(F.col("_word"), False))), ["_part", "_n"])
    near = met.select(column, "_word", "_n").distinct().withColumn("_d", F.levenshtein(F.col(column), F.col("_word"))).where(1 - F.col("_d") / F.col("_n") >= theta)
    best = near.groupBy(column).agg(F.min_by("_word", F.struct("_d", "_word")).alias("_fuzzy"))
    out = strict.join(best, column, "left")
    return out.select(*rows.columns, F.coalesce("matched", "_fuzzy").alias("matched"), F.coalesce("via", F.when(F.col("_fuzzy").isNotNull(), "fuzzy")).alias("via"))


def band(rows: DataFrame, others: DataFrame, key: str, left: str, right: str, tolerance: float) -> DataFrame:
    """Inner join on key where the two amounts are within the tolerance."""
    return rows.join(others, key).where(F.abs(F.col(left) - F.col(right)) <= tolerance)


def only_match(matches: DataFrame, row: str, other: str) -> DataFrame:
    """Of matches, the rows that have exactly one partner."""
    return matches.groupBy(row).agg(F.count("*").alias("_n"), F.max(other).alias(other)).where("_n = 1").select(row, other)


def missing_and_extra(ours: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key and side (`missing`: expected only, `extra`: ours only)."""
    a, b = ours.select(key).distinct(), expected.select(key).distinct()
    missing = b.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("extra")))


def numbered(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
