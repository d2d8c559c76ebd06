"""The trie's candidates against a copy of every series per candidate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_tables import long_table, series_frame
from tidegauge.domains import IMPUTATION_FIRST, OUTLIER_FIRST
from tidegauge.functions.series import Series
from tidegauge.operators import forest, smooth
from tidegauge.plans import benchmark as B
from tidegauge.plans import trie
from tidegauge.plans.clean import Settings

ORDERS = (IMPUTATION_FIRST, OUTLIER_FIRST)


def odd_frame():
    """Waves with gaps, a signal with few values, one without any, and a short recording."""
    pdf = series_frame(seed=3, recordings=2, n=140, signals=("a", "b", "c"))
    pdf.loc[(pdf.recording_id == "r1") & (pdf.signal == "c") & (pdf.idx > 60) & (pdf.idx % 40 != 1), "value"] = np.nan
    short = series_frame(seed=4, recordings=1, n=12, missing=0.1, signals=("a", "b", "c"))
    short.recording_id = "short"
    short.loc[(short.signal == "b"), "value"] = np.nan
    return [pdf, short]


def scores(spark, s, methods, semantics, domains, block_trie, monkeypatch):
    if block_trie:
        monkeypatch.setattr(B, "LIGHT", {k: () for k in trie.LIGHT})
    out = B.scenario_results(s, [0, 20], methods, domains, Settings(signals=("a", "b", "c"), semantics=semantics), 50.0, ORDERS)
    pdf = out.toPandas().sort_values(["seed", "severity_pct", *B.CANDIDATE]).reset_index(drop=True)
    return pdf.reindex(sorted(pdf.columns), axis=1)


@pytest.mark.parametrize("semantics", ["app", "bench"])
def test_equals_copies(spark, monkeypatch, semantics):
    import pandas as pd
    frame = pd.concat(odd_frame(), ignore_index=True)
    s = Series.of(long_table(spark, frame))
    domains = spark.createDataFrame([("r0", "energy"), ("r1", "finance"), ("short", "network")], "recording_id string, domain string")
    methods = {k: list(v) for k, v in trie.LIGHT.items()} | {"scaling": ["none"]}
    ours = scores(spark, s, methods, semantics, domains, False, monkeypatch)
    copies = scores(spark, s, methods, semantics, domains, True, monkeypatch)
    assert len(ours) == 3 * 2 * 200 == len(copies)
    for c in ours.columns:
        if ours[c].dtype == float:
            np.testing.assert_allclose(ours[c], copies[c].astype(float), atol=2e-7, rtol=1e-6, err_msg=c)
        else:
            assert ours[c].tolist() == copies[c].tolist(), c


def test_methods_across_rows_are_added(spark):
    s = Series.of(long_table(spark, series_frame(seed=5, recordings=2, n=80)))
    domains = spark.createDataFrame([("r0", "energy"), ("r1", "finance")], "recording_id string, domain string")
    methods = {"outlier": ["none", "isolation_forest"], "imputation": ["linear", "knn"], "scaling": ["none"], "smoothing": ["none"]}
    out = B.scenario_results(s, [10], methods, domains, Settings(signals=("a", "b"), semantics="bench"), 50.0, ORDERS)
    got = out.groupBy("outlier", "imputation").agg(F.count("*").alias("n"), F.count_if("valid_rmse").alias("valid")).collect()
    assert sorted((r.outlier, r.imputation, r.n, r.valid) for r in got) == [(o, i, 4, 4) for o in ("isolation_forest", "none") for i in ("knn", "linear")]


def test_leaves_in_parts(spark, monkeypatch):
    """A matrix of few cells at a time gives the same leaves."""
    s = Series.of(long_table(spark, series_frame(seed=6, recordings=2, n=60))).with_column("clean", F.col("value"))
    methods = {k: list(v) for k, v in trie.LIGHT.items()}
    rows = lambda: sorted(map(str, trie.leaf_measures(s, methods, ORDERS, 50.0).collect()))
    whole = rows()
    assert len(whole) == 2 * 2 * 201
    monkeypatch.setattr(trie, "CELLS", 1)
    assert rows() == whole
    with pytest.raises(ValueError):
        trie.leaf_measures(s, methods | {"imputation": ["knn"]}, ORDERS, 50.0)


def test_no_candidate_is_written(spark):
    """Per recording one row per candidate and signal leaves the tasks, whatever the length."""
    s = Series.of(long_table(spark, series_frame(seed=7, recordings=1, n=600))).with_column("clean", F.col("value"))
    plan = trie.leaf_measures(s, {"outlier": ["none"], "imputation": ["linear"], "smoothing": ["none"]}, ORDERS, 50.0)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # the fixture's own, and by recording
    assert plan.count() == 2 * 3


def test_one_signal_runs_all_methods_in_the_trie(spark, monkeypatch):
    """Methods that look across signals give on one signal what copies give, and no copy is made for them."""
    frame = series_frame(seed=8, recordings=2, n=40, missing=0.1, signals=("a",))
    short = series_frame(seed=9, recordings=1, n=12, missing=0.1, signals=("a",))
    short.recording_id = "short"
    s = Series.of(long_table(spark, pd.concat([frame, short], ignore_index=True)))
    domains = spark.createDataFrame([("r0", "energy"), ("r1", "finance"), ("short", "network")], "recording_id string, domain string")
    methods = {"outlier": ["iqr", "isolation_forest"], "imputation": ["linear", "knn", "mice"], "scaling": ["none"], "smoothing": ["none"]}

    def scores():
        out = B.scenario_results(s, [10], methods, domains, Settings(signals=("a",), semantics="bench"), 50.0, ORDERS)
        return out.toPandas().sort_values(["seed", *B.CANDIDATE]).reset_index(drop=True)

    monkeypatch.setattr(B, "LIGHT", {k: () for k in trie.LIGHT})
    copies = scores()
    monkeypatch.undo()
    monkeypatch.setattr(B, "execute", None)
    ours = scores()
    assert len(ours) == 3 * 12
    for c in ours.columns:
        if ours[c].dtype == float:
            np.testing.assert_allclose(ours[c], copies[c].astype(float), atol=2e-7, rtol=1e-6, err_msg=c)
        else:
            assert ours[c].tolist() == copies[c].tolist(), c


def test_candidates_do_not_shuffle(spark):
    """The candidates' scores and errors leave the tasks as one row per recording copy: nothing is written or joined after them."""
    s = Series.of(long_table(spark, series_frame(seed=7, recordings=2, n=60, signals=("a", "b"))))
    domains = spark.createDataFrame([("r0", "energy"), ("r1", "finance")], "recording_id string, domain string")
    methods = {"outlier": ["none", "iqr"], "imputation": ["linear"], "scaling": ["none"], "smoothing": ["none"]}
    out = B.scenario_results(s, [0, 10], methods, domains, Settings(signals=("a", "b")), 50.0, ORDERS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and plan[:plan.index("MapInArrow")].count("Exchange") <= 1  # the domains
    assert out.count() == 2 * 2 * 4


def test_filters_on_many_rows():
    """Row by row as the filters of one segment, whatever rows are beside it."""
    rng = np.random.default_rng(1)
    for n in (9, 12, 13, 21, 40, 300):
        x = rng.normal(size=(7, n))
        for method, pad in (("moving_median", True), ("moving_median", False), ("savgol", False), ("butterworth", False)):
            got = smooth.rows_smoothed(x, method, pad)
            want = [smooth.moving_median(v, pad) if method == "moving_median" else smooth.FILTERS[method](v) for v in x]
            np.testing.assert_allclose(got, want, atol=1e-12)
            assert (got[2:3] == smooth.rows_smoothed(x[2:3], method, pad)).all(), method


def test_runs_of_all_lengths_together():
    """Every run between gaps is smoothed as it is alone."""
    rng = np.random.default_rng(2)
    for n, share in ((8, 0.0), (9, 0.0), (40, 0.05), (300, 0.02), (300, 0.1), (60, 0.6), (20, 1.0)):
        x = rng.normal(size=(11, n)) * 1e4
        x[rng.random(x.shape) < share] = np.nan
        for method, pad in (("moving_median", True), ("moving_median", False), ("savgol", False), ("butterworth", False)):
            want = x.copy()
            for row, out in zip(x, want):
                for run in np.ma.clump_unmasked(np.ma.masked_invalid(row)):
                    if run.stop - run.start >= smooth.MIN_SEGMENT:
                        out[run] = smooth.moving_median(row[run], pad) if method == "moving_median" else smooth.FILTERS[method](row[run])
            np.testing.assert_allclose(smooth.parts_smoothed(x, method, pad), want, rtol=1e-9, atol=1e-9)


def test_correlation_of_common_cells():
    """As the definition on the common cells, also where a side is constant there or nearly so."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(6, 50)) + 1e6, rng.normal(size=(6, 50))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[1], y[2] = 0.1, np.nan
    y[3, np.flatnonzero(~np.isnan(x[3]))[1:]] = np.nan
    y[4, 5:] = np.nan
    y[4, :5] = 7.0
    at = np.arange(6)[None, :]
    got = trie.correlations([(v, np.arange(6), at) for v in (x, y)])[0, 0]
    for k in range(6):
        both = ~np.isnan(x[k]) & ~np.isnan(y[k])
        if k in (1, 2, 3, 4):
            assert np.isnan(got[k])
        else:
            np.testing.assert_allclose(got[k], abs(np.corrcoef(x[k, both], y[k, both])[0, 1]), rtol=1e-6)


def test_code_goes_to_the_tasks_after_other_queries(spark):
    """The tasks' code holds no function of Spark's, which can't be sent once it was used."""
    forest._pick_udf(F.lit("a"), F.lit(20))
    s = Series.of(long_table(spark, series_frame(seed=7, recordings=1, n=30, signals=("a",))))
    s = s.on(s.df.withColumn("clean", F.col("value")))
    methods = {"outlier": ["none"], "imputation": ["linear"], "smoothing": ["none"]}
    assert trie.leaf_measures(s, methods, ORDERS, 50.0).count() == 3


def test_forests_of_one_signal():
    """Scores from ranges of sorted values are, bit by bit, those of trees that are grown and walked."""
    rng = np.random.default_rng(0)
    for n in (16, 67, 256, 300):
        x = rng.normal(size=(4, n))
        x[1], x[2], x[3, :n // 2] = 3.3, rng.integers(0, 4, n), 0.0
        names = [f"42:{i}:a" for i in range(4)]
        want = [forest.whole_scores(v[:, None], name) for v, name in zip(x, names)]
        assert (forest.line_scores(x, names) == np.array(want)).all(), n
    assert forest.line_scores(np.empty((0, 20)), []).shape == (0, 20)


def test_recording_of_two_domains(spark, monkeypatch):
    """Each domain's scores stand beside the uncleaned copy under each domain, as with copies."""
    s = Series.of(long_table(spark, series_frame(seed=8, recordings=1, n=40, signals=("a",))))
    domains = spark.createDataFrame([("r0", "energy"), ("r0", "finance"), ("r0", "finance")], "recording_id string, domain string")
    methods = {"outlier": ["none"], "imputation": ["linear"], "scaling": ["none"], "smoothing": ["none"]}

    def rows():
        out = B.scenario_results(s, [10], methods, domains, Settings(signals=("a",)), 50.0, ORDERS)
        return sorted((r.domain, r.order, round(r.q_score, 6), round(r.delta_q, 6)) for r in out.collect())

    ours = rows()
    monkeypatch.setattr(B, "LIGHT", {k: () for k in trie.LIGHT})
    assert len(ours) == 2 * 9 and ours == rows()
