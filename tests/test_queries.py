"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from stratalog import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "-"
    return str(round(v, 6) if not float(v).is_integer() else int(v)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_have_a_brute_force_test():
    """tests/test_operators.py holds these against another engine on whole documents."""
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"redact_find", "redact_resolve", "redact_apply", "redact_counts"}
