"""Every signal query against its SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from chirpline import catalog

TABLES = ("orders", "lineitem", "customer", "part", "embeddings", "events")


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}" if v else "0"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    want = Counter(tuple(map(plain, row)) for row in cur.fetchall())
    assert sum(want.values()) > 0
    assert got == want


def test_entry(spark):
    assert catalog.entry(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["raster_spectrogram", "query_point", "bilinear_sample", "ascii_spectrogram"])
def test_spectra_are_computed_once(spark, data, name):
    """One Python stage feeds an exchange that all joins share."""
    import re

    plan = catalog.queries()[name](spark, data)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("MapInArrow", text)) == 1


def test_labels_of_ties_and_nulls_match_sql(spark, tmp_path):
    """Balances whose labels are ties between two decimals, and none."""
    c = duckdb.connect()
    c.execute("create table customer as select row_number() over () - 1 as c_custkey, v::double as c_acctbal from (select unnest([-962.5, -925, -26.5, -25, 0.0, 12.5, 750, 987.5, null]) as v), range(4)")
    c.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    for name in ("time_label_auto", "time_label_timecode"):
        got = sorted(tuple(row) for row in catalog.queries()[name](spark, str(tmp_path)).select("c_custkey", "label").collect())
        assert got == sorted(c.execute(catalog.oracle_sql()[name]).fetchall())
