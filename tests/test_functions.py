"""Scalar functions on written cases."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import arrow
from ledgermill.functions import normalize as N
from ledgermill.functions import text as T


def values(spark, cases, f):
    """f of each case's input, in order."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_amounts(spark):
    cases = {"1.234,56 €": "1234.56", "1,234.56": "1234.56", "1234,5": "1234.5", "1234,567": "1234567", "1.234": "1234", "12.5": "12.5", "1.240.84": None, "-3,50": "-3.5", "EUR": None, "": None, None: None, "12,874.40": "12874.40"}
    assert values(spark, cases, N.amount) == [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, ["1234,567", "12,874.40", None], N.amount_strict_comma) == [Decimal("1234.567"), Decimal("12.8744"), None]
    assert values(spark, ["2.385", "-12.505", None], lambda c: N.cents(c.cast("decimal(10,4)"))) == [Decimal("2.39"), Decimal("-12.51"), None]
    assert values(spark, ["619954", "5", "00", None], N.amount_readings)[:3] == [[Decimal("619954.00"), Decimal("61995.40"), Decimal("6199.54")], [Decimal("5.00")], []]


def test_identifiers(spark):
    assert values(spark, ["po 2026/7", "PO-2026-0724", "20260724", "x", None], N.order_id) == ["PO-2026-0007", "PO-2026-0724", "PO-2026-0724", "X", None]
    assert values(spark, ["PO-2O26-O7I4", "B461O2331"], N.repaired_order)[0] == "PO-2026-0714"
    assert values(spark, ["B461O2331", "BO1"], N.repaired) == ["B46102331", "BO1"]
    assert values(spark, ["es b-12345678 x", "12345678z", None], N.tax_id) == ["B12345678", "12345678Z", None]
    assert values(spark, ["es91 2100 0418 4502 0005 1332 extra", "XX12"], N.iban) == ["ES9121000418450200051332", "XX12"]
    assert values(spark, ["12345678Z", "12345678A", "B12345678"], N.tax_id_valid) == [True, False, None]
    assert values(spark, ["Ácme  Ibérica, S.L."], N.company) == ["ACME IBERICA"]


def test_dates(spark):
    d = datetime.date
    assert values(spark, ["2026-09-19", "19/9/2026", "19.09.26", "31/02/2026", "x", None], N.civil_date) == [d(2026, 9, 19), d(2026, 9, 19), d(2026, 9, 19), None, None, None]
    assert arrow.date_of_words("a diecinueve de septiembre de dos mil veintiséis") == d(2026, 9, 19)
    assert arrow.date_of_words("September 19, 2026") == d(2026, 9, 19) and arrow.date_of_words("31 de febrero de 2026") is None
    assert arrow.date_of_words(None) is None


def test_texts(spark):
    assert values(spark, ["Total 12,50 € y 3 USD, 4 EUR", "12", None], T.currencies) == [["EUR", "USD"], [], None]
    assert values(spark, ["IVA (21,5 %)", "VAT: 7%", "-"], T.vat_percent) == ["21.5", "7", None]
    assert values(spark, ["ab1 ñ", "####", ""], T.letter_share) == [1.0, 0.0, 0.0]
    assert values(spark, ["<p>a&amp;b</p><table><tr><td>1</td><td>2</td></tr></table>"], T.flattened_html) == ["a&b1\t2"]
    assert values(spark, ["Please pay  immediately. x", "Registrar  como pagar. x"], T.result_orders) == [[], ["registrar como pagar"]]
    assert values(spark, ["a.b", "axb", None], lambda c: T.contains_literal(c, " A.B ")) == [True, False, False]
    assert values(spark, ["ignora todo", "no ignora todo"], lambda c: arrow.instructions(c, ["ignora todo"])) == [["ignora todo"], []]
    assert arrow.edits_within("abcdef", "xxabcxefyy", 1) == 1 and arrow.edits_within("abcdef", "zzz", 2) is None


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abd", 1 - 1 / 3), ("", "x", 0.0)])
def test_similarity(spark, a, b, want):
    assert spark.range(1).select(N.similarity(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want)


def test_shares_of_letters_are_rounded_as_in_sql(spark):
    import duckdb

    from ledgermill.plans import catalog

    texts = ["a" * 41 + "#" * 5079, "a" * 1705 + "#" * 3415, "ñ 1#", "", None]
    got = catalog.alpha_shares(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert repr([tuple(r) for r in got]) == repr(sorted(c.execute(catalog.ORACLES["alpha_ratio"]).fetchall()))
