"""Numbers that decide by their last digit: as the SQL engine rounds them."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.series import Series

FIELDS = "recording_id string, signal string, idx long, t double, value double"


@pytest.mark.parametrize("block", [65_536, 4])
def test_window_quantiles_equal_sql_to_the_last_digit(spark, block):
    rng = np.random.default_rng(5)
    rows = [(str(g), "s", i, float(i), float(v)) for g in range(400) for i, v in enumerate(np.round(rng.uniform(-50, 200, 6 + g % 5), 2))]
    df = pd.DataFrame(rows, columns=["recording_id", "signal", "idx", "t", "value"])
    want = duckdb.sql("SELECT recording_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.01) AS c FROM df GROUP BY 1").df()
    s = Series.of(spark.createDataFrame(df, FIELDS), block=block).stats(quantiles={"a": (F.col("value"), 0.25), "b": (F.col("value"), 0.75), "c": (F.col("value"), 0.01)})
    got = s.df.select("recording_id", "a", "b", "c").distinct().toPandas()
    both = got.merge(want, on="recording_id")
    assert len(both) == len(got) == 400
    for c in "abc":
        assert (both[c + "_x"] == both[c + "_y"]).all()


def test_half_way_as_the_sql_engine(spark):
    """Estimates met in 3.6 million line items: the digits of the double say one thing, its product with 100,000 another."""
    from tidegauge.catalog.base import rounded_product
    rows = spark.createDataFrame([(0.050624999999999996,), (39898.535624999997,), (-0.25,), (None,)], "x double")
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 5)", [r.x]).fetchone()[0] for r in rows.collect()]
    assert [r.x for r in rounded_product(rows, 5).collect()] == want == [0.05063, 39898.53562, -0.25, None]
