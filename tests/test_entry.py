"""Every query that has SQL, against DuckDB on the smallest tables; skipped where these are absent."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from ledgermill.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
QUICK = ["reconcile_three_way", "rule_coverage", "ledger_dedup_keep_lowest", "ledger_upsert", "corrections_merge", "fuzzy_id_match", "strict_id_match", "band_join_amount", "fulldiff_decisions", "nearest_rank_percentiles", "amount_parse", "hash_chain_build", "hash_chain_verify", "delivery_violations", "arithmetic_coherence"]


def rows(df):
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") or hasattr(x, "dtype") else str(x)[:10] if hasattr(x, "year") else str(x)
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(catalog.ORACLES[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert not math.isnan(len(__spark_entry__.queries()))
