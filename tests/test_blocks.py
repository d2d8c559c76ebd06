"""The block plan of a long series gives what the plain plan gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_tables import collected, long_table, series_frame
from tidegauge.functions.series import Series, ordered_index
from tidegauge.functions.scalar import wide_form
from tidegauge.operators import knn, mice, smooth, timeaxis, validate, windows
from tidegauge.operators import corrupt, forest
from tidegauge.operators import profile as P
from tidegauge.operators.impute import impute
from tidegauge.operators.outliers import handle

KEYS = ["recording_id", "signal", "idx"]


@pytest.fixture(scope="module")
def table(spark):
    return long_table(spark, series_frame()).cache()


def both(table, keys=("recording_id", "signal"), block=32):
    return Series.of(table, keys), Series.of(table, keys, block=block)


def same(a, b, keys, tol=1e-9):
    pd.testing.assert_frame_equal(collected(a, keys), collected(b, keys), check_dtype=False, rtol=tol, atol=tol)


def test_scan(table):
    v = F.col("value")
    out = [s.scan(last={"p": v}, first={"n": v}, lag={"b": v}, lead={"a": v}, total={"c": v}).df for s in both(table)]
    assert not both(table)[0].blocked and both(table)[1].blocked
    same(*out, KEYS)


def test_running_sum_keeps_its_type(table):
    kinds = [dict(s.scan(total={"c": F.col("idx")}).df.dtypes)["c"] for s in both(table)]
    assert kinds == ["bigint", "bigint"]


def test_ordered_index_of_repeated_values(spark):
    """One series with 99 % of the rows, a single lead value in most of them, nulls, and ties down to the last column."""
    rng = np.random.default_rng(6)
    rows = [("hot", 1.0 if i % 10 else float(rng.integers(0, 4)), None if i % 50 == 0 else int(rng.integers(0, 3)), i) for i in rng.permutation(3000)]
    rows += [("cold", 2.0, 1, i) for i in range(30)]
    df = spark.createDataFrame([(k, a, b, int(c)) for k, a, b, c in rows], "k string, a double, b int, c long")
    plain, cuts = (ordered_index(df, ["k"], ["a", "b", "c"], F.col("a"), 3000, 2, block) for block in (10_000, 16))
    same(plain, cuts, ["k", "idx"])
    assert plain.dtypes == cuts.dtypes


def test_ranges_of_repeated_values_are_cut(spark):
    from tidegauge.functions.series import _split_ties
    df = spark.range(4000).select(F.lit("r").alias("k"), F.lit(1.0).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("c"), F.array(F.lit(7).cast("long")).alias("_rng"))
    sizes = [r["count"] for r in _split_ties(df, ["k"], ["a", "b", "c"], 50).groupBy("_rng").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 100


def test_stats_and_quantiles(table):
    v = F.col("value")
    out = [s.stats({"m": F.avg("value")}, {f"q{i}": (v, p) for i, p in enumerate((0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0))}).df for s in both(table)]
    same(*out, KEYS)


def test_quantiles_from_brackets(spark, monkeypatch):
    """Long groups: only the rows between two sketched values are sorted."""
    from tidegauge.functions import quantile
    monkeypatch.setattr(quantile, "ACCURACY", 40)
    rng = np.random.default_rng(4)
    rows = [(r, "s", i, float(i), float(v)) for r, xs in (("a", rng.normal(size=4000)), ("b", np.round(rng.exponential(2, 3000), 1)), ("c", [3.0] * 900))
            for i, v in enumerate(xs)]
    t = spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double")
    probs = {f"q{i}": (F.col("value"), p) for i, p in enumerate((0.0, 0.01, 0.05, 0.25, 0.5, 0.8, 0.95, 0.99, 1.0))}
    same(*[s.summary({"n": F.count("value")}, probs) for s in (Series.of(t), Series.of(t, block=50))], ["recording_id"])


def test_quantiles_of_repeated_values(spark):
    rows = [("r", "s", i, i / 10.0, float(i % 3)) for i in range(500)] + [("q", "s", i, i / 10.0, 1.0) for i in range(90)]
    t = spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double")
    out = [s.summary({"n": F.count("value")}, {"a": (F.col("value"), 0.33), "b": (F.col("value"), 0.5)}) for s in both(t)]
    same(*out, ["recording_id"])


def test_attach_without_broadcast(table, monkeypatch):
    import tidegauge.functions.series as mod
    monkeypatch.setattr(mod, "BROADCAST_ROWS", 0)
    a, b = both(table)
    side = lambda s: s.summary({"m": F.avg("value"), "_hi": F.max("idx")}, {"q": (F.col("value"), 0.5)})
    same(a.attach(side(a)).df.drop("_hi"), b.attach(side(b)).df, KEYS)


def test_ordered_index(table):
    t = table.drop("idx")
    out = [ordered_index(t, ["recording_id", "signal"], ["t"], F.col("t"), 180, 6, block) for block in (1000, 16)]
    same(*out, KEYS)


def test_profile(table):
    out = [P.feature_profile(s, 50.0) for s in both(table)]
    same(*out, ["recording_id", "signal"], 1e-7)
    same(*[P.measurements(s) for s in both(table)], ["recording_id", "signal"], 1e-7)


def test_time_diagnostics(table):
    t = table.filter("signal = 'a'")
    same(*[timeaxis.diagnostics(s) for s in both(t, ("recording_id",))], ["recording_id"])


def test_cleaning(table):
    for method in ("zscore", "iqr", "mad", "winsorize"):
        same(*[handle(s, [method]).df for s in both(table)], KEYS)
    same(*[impute(s, ["mean", "median", "locf", "linear"], 0.2).df for s in both(table)], KEYS)


def test_smoothing_chunks(table, monkeypatch):
    methods = ["moving_median", "savgol", "butterworth"]
    full = impute(both(table)[0], ["linear"])
    full = full.on(full.df.withColumn("value", F.col("imp_linear")))
    whole = collected(smooth.smooth(full, methods).df, KEYS)
    monkeypatch.setattr(smooth, "CHUNK", 30)
    cutup = collected(smooth.smooth(Series(full.df, full.keys, full.longest, full.groups, 32), methods).df, KEYS)
    pd.testing.assert_frame_equal(whole, cutup, rtol=1e-9, atol=1e-9)


def test_smoothing_on_a_grid(table, monkeypatch):
    jitter = table.withColumn("t", F.col("t") + 0.004 * F.sin(F.col("idx").cast("double")))
    run = lambda s: smooth.smooth(s, ["moving_median", "savgol"], irregular=F.lit(True), resample=True, fs=F.lit(50.0)).df
    a, b = both(jitter)
    whole = collected(run(a), KEYS)
    monkeypatch.setattr(smooth, "CHUNK", 25)
    cutup = collected(run(b), KEYS)
    pd.testing.assert_frame_equal(whole, cutup, rtol=1e-9, atol=1e-9)


def test_corruption(table):
    full = both(table.withColumn("value", F.coalesce("value", F.lit(0.0))))
    for kind in corrupt.KINDS:
        same(*[corrupt.inject(s, kind, 0.2).df for s in full], KEYS)
    same(*[corrupt.nested(s, 0.15).df for s in full], KEYS)


def test_windows(table):
    wide = wide_form(table, ["a", "b"], ["recording_id", "idx", "t"])
    out = [windows.complete_window(s, ["a", "b"], 12).df for s in both(wide, ("recording_id",))]
    same(*out, ["recording_id", "idx"])
    same(*[windows.longest_run(s, ["a", "b"]) for s in both(wide, ("recording_id",))], ["recording_id"])


def test_losses(table):
    hurt = [corrupt.inject(s, "spikes", 0.1) for s in both(table.withColumn("value", F.coalesce("value", F.lit(0.5))))]
    same(*[validate.signal_losses(s) for s in hurt], ["recording_id", "signal"], 1e-7)


def test_knn_long_search(table):
    wide = wide_form(table, ["a", "b"], ["recording_id", "idx", "t"]).withColumn("c", F.cos(F.col("idx") / 5))
    out = [knn.estimates(s, ["a", "b", "c"]) for s in both(wide, ("recording_id",))]
    same(*out, KEYS, 1e-7)


def test_mice_blocks(table):
    wide = wide_form(table, ["a", "b"], ["recording_id", "idx", "t"]).withColumn("c", F.cos(F.col("idx") / 5))
    out = [mice.estimates(s, ["a", "b", "c"]) for s in both(wide, ("recording_id",))]
    same(*out, KEYS, 1e-7)


@pytest.mark.parametrize("scale", [1e-6, 1.0])
def test_knn_in_many_ranges(spark, monkeypatch, scale):
    """Clusters, repeated values and a far row, in ranges of about two donors and in one group."""
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(0, 0.01, 150), rng.normal(50, 1, 100), np.full(40, 7.0), [1e4]])
    a, b = a * scale, rng.normal(0, 1, len(a)) * scale
    gone = rng.random(len(a)) < 0.2
    rows = [("r", i, float(a[i]), None if gone[i] else float(b[i])) for i in range(len(a))]
    df = spark.createDataFrame(rows, "recording_id string, idx long, a double, b double")
    plain = collected(knn.estimates(Series.of(df, ("recording_id",)), ["a", "b"], scaled=False), ["idx"])
    monkeypatch.setattr(knn, "LEAF", 2)
    monkeypatch.setattr(knn, "PARTS", 4)
    ranges = collected(knn.estimates(Series.of(df, ("recording_id",), 64), ["a", "b"], scaled=False), ["idx"])
    assert len(plain) == gone.sum()
    pd.testing.assert_frame_equal(plain, ranges, rtol=1e-9, atol=0)


def test_short_and_long_forests_agree(spark, monkeypatch):
    """Recordings of 20, 300 and 700 rows, scored whole and in chunks of 64."""
    rng = np.random.default_rng(4)
    rows = [(f"r{n}", i, float(rng.normal()), float(rng.integers(0, 5))) for n in (20, 300, 700) for i in range(n)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, idx long, a double, b double"), ("recording_id",))
    a = collected(forest.row_scores(s, ["a", "b"]), ["recording_id", "idx"])
    monkeypatch.setattr(forest, "CHUNK", 64)
    b = collected(forest.row_scores(s, ["a", "b"]), ["recording_id", "idx"])
    assert len(a) == 1020
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_short_recordings_are_completed_where_they_are_scored(spark):
    """No window over the rows, and the scores of recordings that the windows completed; one signal has no value at all."""
    rng = np.random.default_rng(5)
    rows = [(f"r{r}", i, None if i < 3 or rng.random() < 0.3 else float(rng.normal()), None if r == 2 else float(rng.integers(0, 5)), None if i > 60 else i)
            for r, n in enumerate((16, 90, 300, 15)) for i in range(n)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, idx long, a double, b double, c long").repartition(3), ("recording_id",))
    got = forest.row_scores(s, ["a", "b", "c"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    full = P.fill_columns(s, ["a", "b", "c"]).df.toPandas().sort_values(["recording_id", "idx"])
    got = collected(got, ["recording_id", "idx"])
    assert sorted(got.recording_id.unique()) == ["r0", "r1", "r2"]
    for name, part in got.groupby("recording_id"):
        x = full[full.recording_id == name][["a", "b", "c"]].to_numpy(float)
        np.testing.assert_array_equal(part.score.to_numpy(), forest.whole_scores(x, f"42:{name}"))


def test_forest_does_not_depend_on_layout(table):
    wide = wide_form(table, ["a", "b"], ["recording_id", "idx", "t"])
    a = forest.row_scores(Series.of(wide.repartition(1), ("recording_id",)), ["a", "b"])
    b = forest.row_scores(Series.of(wide.repartition(7), ("recording_id",), block=32), ["a", "b"])
    same(a, b, ["recording_id", "idx"], 1e-9)
    score = a.join(wide, ["recording_id", "idx"]).toPandas()
    far = score[(score.a.abs() > 6)]
    assert far.score.mean() > score.score.mean() + 0.1
    assert np.isfinite(score.score).all()


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Whole recordings go to more tasks as rows grow, so a chain of sorts stays in memory."""
    from tidegauge.sources import tables
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    df = spark.range(5000).select((F.col("id") % 250).alias("rec"), "id", F.col("id").cast("double").alias("v"))
    s = tables.as_long(tables.recordings(df, F.col("rec"), ["id"], F.col("id"), {"a": F.col("v"), "b": -F.col("v")}, rate_hz=1.0), ["a", "b"])
    s = s.scan(lag={"_p": F.col("value")})
    rows = s.df.groupBy(F.spark_partition_id().alias("task"), "recording_id").count().collect()
    assert len({r["task"] for r in rows}) > 20 and len(rows) == 250
    assert sum(r["count"] for r in rows) == 10_000


def test_knn_long_search_sends_few_leaves_at_a_time(spark, monkeypatch):
    """A leaf holds thousands of donors; what a Python worker gets at once doesn't grow with the leaves."""
    search, most = knn._search_udf, 4

    def checked():
        inner = search().func

        @F.pandas_udf(knn.QUERY_FOUND)
        def run(queries: pd.Series, donors: pd.Series, k: pd.Series) -> pd.Series:
            if len(queries) > most:
                raise ValueError(f"{len(queries)} leaves at a time")
            return inner(queries, donors, k)
        return run

    rows = [("r", i, float((i * 37) % 400), None if i % 3 == 0 else float(i % 11)) for i in range(400)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, idx long, a double, b double"), ("recording_id",), 64)
    want = collected(knn.estimates(s, ["a", "b"], scaled=False), ["idx"])
    monkeypatch.setattr(knn, "_search_udf", checked)
    monkeypatch.setattr(knn, "LEAF", 2)
    monkeypatch.setattr(knn, "LEAVES", most, raising=False)
    got = collected(knn.estimates(s, ["a", "b"], scaled=False), ["idx"])
    assert len(got) == 134 and got["estimate"].tolist() == pytest.approx(want["estimate"].tolist())
