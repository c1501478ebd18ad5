"""Amounts, identifiers and dates as column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# What scanners read for digits, and the lengths of IBANs by country.
OCR_LETTERS, OCR_DIGITS = "OQDILZEASGTBP", "0001123456789"
IBAN_LENGTHS = {"ES": 24, "FR": 27, "DE": 22, "IT": 27, "PT": 25, "NL": 18, "BE": 16, "GB": 22, "IE": 22, "LU": 20, "CH": 21, "BR": 29, "JP": 23}


def cents(x: Column) -> Column:
    """Rounded half up to two decimals."""
    return F.round(x.cast("decimal(28,8)"), 2).cast(MONEY)


def amount(text: Column) -> Column:
    """A written amount as a decimal; null if it is none.

    Of comma and dot, the one further right is the decimal mark. A lone comma is one with one or two digits after it, else it groups thousands; dots alone group thousands where they stand before groups of three.
    """
    return parsed(plain_amount(F.regexp_replace(text, r"[^0-9.,\-]", "")))


def plain_amount(s: Column) -> Column:
    """s with a dot for the decimal mark and nothing for thousands."""
    comma, dot = F.locate(",", s) > 0, F.locate(".", s) > 0
    last_comma, last_dot = F.length(F.substring_index(s, ",", -1)), F.length(F.substring_index(s, ".", -1))
    return (
        F.when(comma & dot & (last_comma < last_dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot, F.replace(s, F.lit(","), F.lit("")))
        .when(comma & s.rlike(r"^-?[0-9]*,[0-9]{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(comma, F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+$"), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(s)
    )


def parsed(plain: Column) -> Column:
    """A number with a dot for the decimal mark as a decimal; null if it is none."""
    return F.when(plain.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), plain.try_cast("decimal(28,8)"))


def amount_strict_comma(text: Column) -> Column:
    """The older dialect: dots always group thousands, the comma is the decimal mark."""
    s = F.replace(F.replace(F.regexp_replace(text, r"[^0-9.,\-]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("decimal(28,8)"))


def amount_readings(text: Column) -> Column:
    """What an amount whose punctuation was lost may be: its digits with no, one or two decimals; positive, distinct, in this order."""
    d = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(d)
    cut = lambda k: F.when(n > k, F.concat(F.substr(d, F.lit(1), n - k), F.lit("."), F.substr(d, n - k + 1, F.lit(k))))
    found = F.array(F.when(n > 0, d), cut(1), cut(2))
    values = F.transform(found, lambda x: x.try_cast(MONEY))
    return F.array_distinct(F.filter(values, lambda x: x > 0))


def order_id(text: Column) -> Column:
    """PO-YYYY-NNNN from the end of the text without punctuation, the body padded to four digits, a year of three digits as it is; where nothing fits, the text without punctuation."""
    return order_of(bare(text))


def bare(text: Column) -> Column:
    """Capitals and digits alone."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def order_of(s: Column) -> Column:
    """order_id of what bare gives. Inside lambdas Spark shares no work: there, take these a step at a time."""
    a, b = r"PO([0-9]{3,4})([0-9]{1,4})$", r"([0-9]{4})([0-9]{3,4})$"
    made = lambda p: F.concat(F.lit("PO-"), F.regexp_extract(s, p, 1), F.lit("-"), F.lpad(F.regexp_extract(s, p, 2), 4, "0"))
    return F.when(s.rlike(a), made(a)).when(s.rlike(b), made(b)).otherwise(s)


def tax_id(text: Column) -> Column:
    """Without punctuation, in capitals, cut to the first legal form."""
    s = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    form = r"^(?:ES)?([A-Z][0-9]{7}[A-Z0-9]|[0-9]{8}[A-Z])"
    return F.when(s.rlike(form), F.regexp_extract(s, form, 1)).when(s != "", s)


def iban(text: Column) -> Column:
    """Without punctuation, in capitals, cut to its country's length."""
    s = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.substring(s, 1, 2)), F.length(s))
    return F.when(s != "", F.substr(s, F.lit(1), size))


def repaired(text: Column) -> Column:
    """Digits for letters that scanners read for them, after the leading letters, which stay."""
    head = F.regexp_extract(text, "^([A-Z]+)", 1)
    return F.concat(head, F.translate(F.substr(text, F.length(head) + 1), OCR_LETTERS, OCR_DIGITS))


def repaired_order(text: Column) -> Column:
    """An order id whose digits were read as letters, where the rest is in place."""
    return order_of(digits_of_order(bare(text)))


def digits_of_order(s: Column) -> Column:
    """What bare gives, with digits for letters after the PO."""
    return F.when(s.startswith("PO"), F.concat(F.lit("PO"), F.translate(F.substr(s, F.lit(3)), OCR_LETTERS, OCR_DIGITS))).otherwise(s)


def civil_date(text: Column) -> Column:
    """ISO, or day/month/year with two or four digits for the year; null for dates that don't exist."""
    return date_of(slashed(text))


def slashed(text: Column) -> Column:
    """A date's parts with slashes between them."""
    return F.regexp_replace(F.trim(text), r"[\-.]", "/")


def date_of(s: Column) -> Column:
    """civil_date of what slashed gives."""
    long = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    short = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$"
    made = lambda p, c: F.concat_ws("-", F.concat(F.lit(c), F.regexp_extract(s, p, 3)), F.lpad(F.regexp_extract(s, p, 2), 2, "0"), F.lpad(F.regexp_extract(s, p, 1), 2, "0"))
    iso = F.when(s.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.replace(s, F.lit("/"), F.lit("-"))).when(s.rlike(long), made(long, "")).when(s.rlike(short), made(short, "20"))
    return F.try_to_date(iso, "yyyy-M-d")


def folded(text: Column) -> Column:
    """Capitals without accents, white space as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.upper(text), "ÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÄËÏÖ", "AEIOUUNCAEIOUAEIOUAEIO"), r"\s+", " "))


def company(text: Column) -> Column:
    """A company's name without legal form."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), "[^A-Z0-9 ]", ""), r" (SL|SA|SLU|SAU|SC|GMBH|LTD|SARL|INC)$", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer; 0 if either is empty."""
    size = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / size)


def tax_id_valid(nif: Column) -> Column:
    """Whether a personal id's letter fits its number (of other forms: null)."""
    n = F.regexp_extract(nif, r"^([0-9]{8})[A-Z]$", 1)
    letter = F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (n.try_cast("int") % 23 + 1), F.lit(1))
    return F.when(n != "", letter == F.right(nif, F.lit(1)))
