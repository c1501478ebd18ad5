"""Functions that built-in expressions can't express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import datetime
import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

# Month names and number words of Spanish and English.
MONTHS = {
    **{m: i + 1 for i, m in enumerate("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())},
    **{m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())},
    "setiembre": 9,
}
UNITS = {w: i for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho veintinueve".split())}
TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
NEGATIONS = ("no ", "not ", "nunca ", "never ", "sin ")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def normalised(column, form: str = "NFKC"):
    """Unicode normalisation."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run(column)


def number_in_words(words: list[str]) -> int | None:
    """The number that Spanish number words make (thousands, hundreds of a year, tens and units); None if they make none."""
    total = part = 0
    seen = False
    for w in words:
        if w == "y":
            continue
        if w.isdigit():
            part += int(w)
        elif w in UNITS:
            part += UNITS[w]
        elif w in TENS:
            part += TENS[w]
        elif w == "mil":
            total, part = total + max(part, 1) * 1000, 0
        else:
            return None
        seen = True
    return total + part if seen else None


def date_of_words(text: str | None) -> datetime.date | None:
    """The date around the first month name: the number before it is the day, what follows is the year."""
    words = re.findall(r"[a-z]+|[0-9]+", _plain(text or ""))
    for k, w in enumerate(words):
        if w not in MONTHS:
            continue
        before = [x for x in words[max(0, k - 4) : k] if x not in {"de", "del", "of", "dia", "el", "a", "the", "st", "nd", "rd", "th"}]
        after = [x for x in words[k + 1 : k + 8] if x not in {"de", "del", "of", "ano"}]
        day = next((d for i in range(len(before)) if (d := number_in_words(before[i:])) is not None), None)
        year = next((y for i in range(len(after), 0, -1) if (y := number_in_words(after[:i])) is not None), None)
        if day is None and year is not None and after and after[0].isdigit() and len(after) > 1 and after[1].isdigit():
            day, year = int(after[0]), int(after[1])  # month day, year
        try:
            return datetime.date(year, MONTHS[w], day)
        except (TypeError, ValueError):
            continue
    return None


def date_in_words(column):
    @F.pandas_udf("date")
    def run(s: pd.Series) -> pd.Series:
        return s.map(date_of_words)

    return run(column)


def matching_ratio(a, b):
    """Share of characters in matching blocks (Ratcliff and Obershelp)."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)])

    return run(a, b)


def edits_within(needle: str, text: str, most: int) -> int | None:
    """The least edit distance of needle to any part of text, if at most `most`: one row of the table at a time."""
    if needle in text:
        return 0
    row = list(range(len(needle) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(needle):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best if best <= most else None


def found_with_edits(needle, text):
    """Edits with which needle occurs in text, ignoring what is no letter or digit: at most one under 12 characters, else two; null if it doesn't."""

    @F.pandas_udf("int")
    def run(n: pd.Series, t: pd.Series) -> pd.Series:
        def one(a, b):
            a, b = (re.sub(r"[^a-z0-9]", "", (x or "").lower()) for x in (a, b))
            return edits_within(a, b, 1 if len(a) < 12 else 2) if len(a) >= 4 else None

        return pd.Series([one(a, b) for a, b in zip(n, t)], dtype="object")

    return run(needle, text)


def instructions(column, phrases: list[str]):
    """Of the phrases (plain lower case), those in the text that no negation stands right before."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            t = re.sub(r"\s+", " ", _plain(x or ""))
            return [p for p in phrases if any(not t[max(0, m.start() - 8) : m.start()].endswith(NEGATIONS) for m in re.finditer(re.escape(p), t))]

        return s.map(one)

    return run(column)
