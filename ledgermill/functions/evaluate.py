"""Readings of a page against what it says: edit distance over long texts, and fields as sets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.readings import plausible_amounts

# Forms of the fields that are compared, and how alike a value must be to a true one not to count as invented.
FORMS = {"nif": r"\b(?:[0-9]{8}[A-Z]|[A-Z][0-9]{7}[0-9A-Z])\b", "iban": r"\bES[0-9]{2}(?: ?[0-9]{4}){5}\b", "fechas": r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b"}
ALIKE = 0.8
#: Bands of the edit distance, tried one after the other: the cost follows the distance, not the square of the length.
BANDS = (32, 256, 2048)


def alnum(text: Column) -> Column:
    """Small letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]", "")


def distance(a: Column, b: Column) -> Column:
    """Edit distance, by bands of growing width."""
    within = lambda band: F.get(F.filter(F.array(F.levenshtein(a, b, band)), lambda x: x >= 0), 0)  # noqa: E731  (-1: beyond it)
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(*[F.when(F.abs(F.length(a) - F.length(b)) <= band, within(band)) for band in BANDS], F.levenshtein(a, b)))


def in_order(text: Column) -> Column:
    """The characters of text, sorted."""
    return F.array_join(F.sort_array(F.split(text, "")), "")


def error_rates(truth: Column, guess: Column) -> Column:
    """A struct of chars (of the truth), cer, and cer_sorted (of sorted characters: what remains if order doesn't count), rounded to four places; 0 where there is no truth."""
    return rates_of(alnum(truth), alnum(guess))


def rates_of(a: Column, b: Column) -> Column:
    """error_rates of what alnum gives. Columns that hold it are best: an expression would be computed for every use."""
    n = F.length(a)
    rate = lambda x, y: F.when((n == 0) | (a == b), F.lit(0.0)).otherwise(F.round(distance(x, y) / n, 4))
    return F.struct(n.cast("long").alias("chars"), rate(a, b).alias("cer"), rate(in_order(a), in_order(b)).alias("cer_sorted"))


def found_fields(text: Column) -> Column:
    """A struct of distinct values by field: nif, iban (without spaces), fechas, importes (two decimals)."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    sets = [F.array_distinct(F.transform(F.regexp_extract_all(upper, F.lit(p), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))).alias(name) for name, p in FORMS.items()]
    money = F.transform(plausible_amounts(F.coalesce(text, F.lit(""))), lambda v: F.round(v, 2).cast("decimal(18,2)").cast("string"))
    return F.struct(*sets, F.array_distinct(money).alias("importes"))


def resembling(values: Column, true: Column) -> Column:
    """How many of the values are like some true one (matching blocks, of letters and digits alone)."""

    @F.pandas_udf("int")
    def run(got: pd.Series, real: pd.Series) -> pd.Series:
        clean = lambda s: "".join(c for c in s.casefold() if c.isalnum())

        def like(a, b):
            a, b = clean(a), clean(b)
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            return a == b or (m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE)

        return pd.Series([sum(any(like(v, r) for r in rs) for v in vs) for vs, rs in zip(got, real)])

    return run(values, true)


#: From which share of matching characters on two lines are the same content, and the least length that is content at all.
SAME_LINE, LEAST_CONTENT = 0.6, 3


def lines_of(text: Column) -> Column:
    """Lines that aren't blank, without white space around them."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def only_in(text: Column, other: Column) -> Column:
    """Lines of text whose content other doesn't have, in order: no line of other is alike (SAME_LINE), and without spaces and punctuation they are in no part of it.

    Lines that other has as they are, fragments, and those that its text holds go by built-in functions; the rest is compared, bounded by length and by common characters before blocks are matched.
    """
    blob = alnum(F.array_join(lines_of(other), ""))
    have = lines_of(other)
    rest = F.filter(lines_of(text), lambda x: ~F.array_contains(have, x) & (F.length(alnum(x)) >= LEAST_CONTENT) & ~F.contains(blob, alnum(x)))

    @F.pandas_udf("array<string>")
    def run(some: pd.Series, others: pd.Series) -> pd.Series:
        def unlike(line, m):
            m.set_seq1(line)
            return m.real_quick_ratio() < SAME_LINE or m.quick_ratio() < SAME_LINE or m.ratio() < SAME_LINE

        def one(a, b):
            left = list(a)
            for other in b:  # what difflib prepares is prepared once a line of other
                if not left:
                    break
                m = difflib.SequenceMatcher(None, "", other, autojunk=False)
                left = [x for x in left if unlike(x, m)]
            return left

        return pd.Series([one(a, b) for a, b in zip(some, others)])

    return F.when(F.size(rest) > 0, run(rest, have)).otherwise(F.array().cast("array<string>"))
