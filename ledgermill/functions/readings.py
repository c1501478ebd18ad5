"""Texts as readers of scans give them: damaged characters, foreign punctuation, amounts as evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.normalize import amount

# Characters of a wrong code page and what they stand for, and characters that can't be seen.
MOJIBAKE = {"\u00a0": " ", "═": "Í", "┴": "Á", "Ê": "Í", "Ý": "í", "ß": "á", "Ú": "É", "§": "ç", "±": "ñ", "Ç": "€"}
INVISIBLE = "\u200b\u200c\u200d\u2060\u200e\u200f\ufeff\u00ad"

# An amount in a text, and the least and greatest that one can be.
AMOUNT = r"[0-9]{1,3}(?:\.[0-9]{3})+(?:[.,][0-9]+)?|[0-9]+,[0-9]+|[0-9]+\.[0-9]+|[0-9]+"
LEAST, GREATEST, SHOWN = 1.0, 10_000_000.0, 24


def searchable(text: Column) -> Column:
    """text without invisible characters, those of a wrong code page put right. For searching, not for keeping."""
    return F.translate(text, "".join(MOJIBAKE) + INVISIBLE, "".join(MOJIBAKE.values()))


def spanish_amounts(text: Column) -> Column:
    """text with amounts that have one mark for thousands and decimals alike (1.234.56, 1,234,56) written with dots and a decimal comma; all else stays, so that a second pass changes nothing."""
    s = F.regexp_replace(text, r"(?<![0-9.,])([0-9]{1,3}(?:\.[0-9]{3})+)\.([0-9]{2})(?![0-9.,])", "$1,$2")
    thousands = r"(?<=(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3}){0,12}),(?=[0-9]{3}(?:,[0-9]{3})*,[0-9]{2}(?![0-9.,]))"
    return F.regexp_replace(s, thousands, ".")


def _written(text: Column) -> Column:
    """Of each number with a decimal mark: raw, and plain, the same with a dot for it and nothing for thousands."""
    raws = F.filter(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda r: r.rlike(r"[.,][0-9]+$"))

    def one(r: Column) -> Column:
        bare = F.replace(r, F.lit("."), F.lit(""))
        tail = F.substring_index(r, ".", -1)
        dots = F.when(F.length(tail) <= 2, F.concat(F.replace(F.substr(r, F.lit(1), F.length(r) - F.length(tail) - 1), F.lit("."), F.lit("")), F.lit("."), tail)).otherwise(bare)
        return F.struct(r.alias("raw"), F.when(F.contains(r, F.lit(",")), F.replace(bare, F.lit(","), F.lit("."))).otherwise(dots).alias("plain"))

    return F.transform(raws, one)


def _decimals(plain: Column) -> Column:
    return F.when(F.contains(plain, F.lit(".")), F.length(F.substring_index(plain, ".", -1))).otherwise(0)


def plausible_amounts(text: Column) -> Column:
    """Plausible amounts of a text, sorted, repeated ones kept (that a sum comes twice is evidence): with a decimal mark and at most two decimals, from 1 to ten million, the first 24. Empty for null."""
    values = F.transform(F.filter(_written(text), lambda w: _decimals(w["plain"]) <= 2), lambda w: w["plain"].try_cast("double"))
    return F.coalesce(F.slice(F.array_sort(F.filter(values, lambda v: v.between(LEAST, GREATEST))), 1, SHOWN), F.array().cast("array<double>"))


def run_together(text: Column) -> Column:
    """Numbers of more than two decimals (two amounts run together), distinct and sorted. Empty for null."""
    found = F.transform(F.filter(_written(text), lambda w: _decimals(w["plain"]) > 2), lambda w: w["raw"])
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def canonical(field: Column, value: Column) -> Column:
    """A field's value in the form in which two readings are compared: account and order without punctuation, amounts as numbers, all in capitals."""
    v = F.upper(F.trim(value))
    return (
        F.when(field.isin("iban", "pedido"), F.regexp_replace(v, r"(?U)[^\p{L}\p{N}]", ""))
        .when(field.isin("total", "base", "iva"), F.coalesce(amount(v).cast("string"), v))
        .otherwise(v)
    )
