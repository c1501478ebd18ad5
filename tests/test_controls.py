"""Gates, audits and readings: written cases, empty tables and nulls; every query against SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import SF, rows

from ledgermill.functions import readings
from ledgermill.operators import controls
from ledgermill.plans import catalog
from ledgermill.plans import controls as plans

NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == plans.__name__]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(catalog.ORACLES[name]).fetchdf())


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "amounts", "malformed"),
    [
        ("1.240.84 y 460.00, 460,00", [460.0, 460.0, 1240.84], []),
        ("1.025,49112121535", [], ["1.025,49112121535"]),
        ("11/04/2026, 21 %, 0,99", [], []),
        ("12.345 y 1.234.567", [12345.0, 1234567.0], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_amounts(spark, text, amounts, malformed):
    assert one(spark, text, readings.plausible_amounts) == amounts
    assert one(spark, text, readings.run_together) == malformed


def test_amounts_shown(spark):
    assert one(spark, " ".join(["5,00"] * 30 + ["9,00"]), readings.plausible_amounts) == [5.0] * 24


@pytest.mark.parametrize(("text", "out"), [("1.234.56", "1.234,56"), ("1,234,56 y 12,345,678,90", "1.234,56 y 12.345.678,90"), ("1.234,56", "1.234,56"), ("1,234.56", "1,234.56"), ("1.234.567", "1.234.567"), ("", ""), (None, None)])
def test_spanish_amounts(spark, text, out):
    assert one(spark, text, readings.spanish_amounts) == out
    assert one(spark, out, readings.spanish_amounts) == out


def test_searchable(spark):
    assert one(spark, "MENSAJER═A R┴PI​DA 1,00 Ç", readings.searchable) == "MENSAJERÍA RÁPIDA 1,00 €"


def test_exceptions(spark):
    classes = spark.createDataFrame([("a", "ALTO"), ("b", "OK"), ("c", "BAJO"), ("d", "MEDIO"), ("f", "BAJO")], "file_id string, conformance string")
    accepted = [("a", "alto", "m", 1), ("b", None, "m", 2), ("c", "ALTO", "m", 3), ("c", "", " m ", 4), ("d", "MEDIO", None, 5), ("e", "", "m", 6), (" f ", "ALTO", "m", 7), (None, "", "m", 8), ("a", "XX", "m", 9)]
    out = controls.accepted_exceptions(classes, spark.createDataFrame(accepted, "file_id string, clase string, motivo string, seq int"), "file_id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("a", None), ("b", "ya_conforme"), ("c", None), ("c", "repetida"), ("d", "sin_motivo"), ("e", "ausente"), ("f", "otra_clase"), (None, "sin_file_id"), ("a", "clase_desconocida")], key=str
    )


def test_divergences(spark):
    given = [("a", "iban", ["ES12 3"], ["es123"]), ("b", "total", ["1234.50"], ["1.234,50 €"]), ("c", "total", ["1234.50"], ["1.234,51"]), ("d", "fecha", [], ["1"]), ("e", "fecha", None, ["1"]), ("f", "nif", ["A", None], ["B"]), ("g", "otro", ["x"], ["y"])]
    out = controls.divergences(spark.createDataFrame(given, "file_id string, campo string, capa array<string>, ocr array<string>"), "file_id")
    assert sorted(map(tuple, out.collect())) == [("c", "total", "critico"), ("f", "nif", "medio"), ("g", "otro", None)]


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert controls.notes_census(none("k int, n array<string>"), "k", F.col("n")).count() == 0
    assert controls.first_rows(none("k int, v string, o int"), "k", "o").count() == 0
    assert controls.grouped_messages(none("m string, l int"), "m", "l").count() == 0
    assert controls.marked_sample(none("k int, m boolean"), "k", F.col("m"), 5, "s").count() == 0
    assert controls.verdict(none("g int, conformance string"), ["g"]).count() == 0
    assert controls.scan_summary(none("d int"), none("d int, score double"), "d").count() == 0


def test_messages_without_lines_and_long_ones(spark):
    given = [("x", None), ("y", 7), ("y", None), *[("z", i) for i in range(9, 0, -1)]]
    out = {r["m"]: (r["n"], r["first_line"], r["lines"]) for r in controls.grouped_messages(spark.createDataFrame(given, "m string, l int"), "m", "l").collect()}
    assert out == {"x": (1, None, ""), "y": (2, 7, "7"), "z": (9, 1, "1, 2, 3, 4, 5 y 4 mas")}


def test_first_rows_with_nulls(spark):
    given = [("p", None, 1), ("p", None, 2), ("p", "i", 3), ("q", "i", 4)]
    out = controls.first_rows(spark.createDataFrame(given, "k string, v string, o int"), "k", "o").orderBy("k").collect()
    assert [tuple(r) for r in out] == [("p", None, 1, 1, 1), ("q", "i", 4, 0, 0)]


def test_sample_keeps_all_marked(spark):
    df = spark.createDataFrame([(i, i < 7) for i in range(50)], "k int, m boolean")
    assert controls.marked_sample(df, "k", F.col("m"), 5, "s").count() == 7
    assert controls.marked_sample(df, "k", F.col("m"), 20, "s").count() == 20
