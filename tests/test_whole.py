"""The whole job is done: queries over all rows, against brute force."""

import hashlib
import os
from collections import defaultdict

import duckdb
import pytest

from ledgermill.operators import reports
from ledgermill.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    return sorted(tuple(x) for x in df.itertuples(index=False))


def sql(name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return rows(c.execute(catalog.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("bits", [14, 6])
def test_fingerprint_takes_every_order(spark, bits):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    groups = defaultdict(lambda: defaultdict(list))
    for s, p, k in orders.collect():
        groups[s, p][k >> bits].append(str(k))
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    want = sorted((*g, sum(map(len, parts.values())), sha(f"{i}:{sha(sorted(parts[i], key=int))}" for i in sorted(parts))) for g, parts in groups.items())
    assert rows(reports.fingerprints(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", bits).toPandas()) == want
    if bits == 14:
        assert rows(catalog.QUERIES["distribution_fingerprint_whole"](spark, SF).toPandas()) == want == sql("distribution_fingerprint_whole", "orders")


def test_coherence_takes_every_document(spark):
    docs = defaultdict(list)
    for k, q in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity").collect():
        docs[k].append(int(q) * 100)
    want = []
    for k, a in docs.items():
        n = range(len(a))
        sums = sum(abs(a[i] + a[j] - a[x]) <= 2 for i in n for j in n if i < j for x in n if x not in (i, j))
        want.append((k, sums, sum(abs(a[i] * 121 - a[j] * 100) <= 200 for i in n for j in n if i != j)))
    assert rows(catalog.QUERIES["arithmetic_coherence_whole"](spark, SF).toPandas()) == sorted(want) == sql("arithmetic_coherence_whole", "lineitem")


def test_ranks_with_outliers(spark):
    """One value far from all others must not put these into one range."""
    import numpy as np

    g = np.random.default_rng(1)
    values = [*(float(x) for x in g.integers(0, 4000, 6000) / 7), 1e18, -1e18]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None)], "g string, v double")
    from ledgermill.operators import tables

    got = {r.g: r for r in tables.at_ranks(df, "g", "v", {"low": lambda n: n * 0, "mid": lambda n: (n / 2).cast("long"), "top": lambda n: n - 1}).collect()}
    s = sorted(values)
    assert (got["a"].low, got["a"].mid, got["a"].top) == (s[0], s[len(s) // 2], s[-1]) and got["b"].top == 1.0 and "c" not in got


def test_repeated_orders(spark):
    from ledgermill.operators import tables

    df = spark.createDataFrame([("b", "1"), ("a", "1"), ("a", "1"), ("c", "2"), ("d", None), ("e", None)], "f string, o string")
    assert sorted(tuple(r) for r in tables.repeated_orders(df, "o", "f").collect()) == [("a", "1", 2, "a"), ("b", "1", 2, "a")]
