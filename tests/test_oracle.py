"""Every query with SQL against DuckDB on the smallest tables, and every other one for its rows."""

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from kinespark.operators import filters
from kinespark.plans import oracle_steps, views
from kinespark.plans.oracle import SQL as PLAIN_SQL
from kinespark.plans.queries import QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
SQL = {**PLAIN_SQL, **oracle_steps.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    keys = [c for c in df.columns if not pd.api.types.is_float_dtype(df[c])] or list(df.columns)
    return df.sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = tidy(QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head(2).tolist(), want[c][~same].head(2).tolist())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() > 0 or name == "significant_pairs"


@pytest.mark.parametrize("warm_up", [0, 20])
def test_madgwick_same_as_sql(spark, duck, warm_up):
    df = views.parent(views.sensor_view(spark, SF)).withColumn("segment", F.lit("parent"))
    got = tidy(views.rounded(filters.run_ahrs(df, ["trial"], ["madgwick"], warm_up)).toPandas())
    want = tidy(duck.execute(oracle_steps.ahrs(*oracle_steps.MADGWICK, warm_up=warm_up)).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)
