"""Stages, whole runs, validation and layout independence."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_tables import collected, long_table, series_frame
from tidegauge.domains import IMPUTATION_FIRST, OUTLIER_FIRST
from tidegauge.functions.scalar import isclose
from tidegauge.functions.series import Series
from tidegauge.operators import corrupt, smooth, validate
from tidegauge.operators.impute import impute
from tidegauge.operators.outliers import handle
from tidegauge.plans import clean as C
from tidegauge.plans import evaluate as E
from tidegauge.settings import cut_in_place

KEYS = ["recording_id", "signal", "idx"]
ST = C.Settings(signals=("a", "b"))


@pytest.fixture(scope="module")
def table(spark):
    return long_table(spark, series_frame(11)).cache()


def one(spark, values, step=0.02):
    rows = [("r", "s", i, i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return Series.of(spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double"))


def column(s, name):
    return [r[name] for r in s.df.orderBy("idx").collect()]


def test_nullable_outliers(spark):
    s = one(spark, [100, 101, None, 101, 100, 500, 102, None, 103, 101])
    out = handle(s, ["zscore", "iqr", "mad", "winsorize"])
    assert column(out, "flag_iqr") == column(out, "flag_mad") == [i == 5 for i in range(10)]
    assert column(out, "out_iqr")[5] is None and column(out, "out_winsorize")[2] is None
    few = handle(one(spark, [1, 1, 1, 1, 1, 1, 99]), ["iqr", "zscore", "mad"])
    assert not any(column(few, "flag_iqr") + column(few, "flag_zscore") + column(few, "flag_mad"))


def test_gaps_and_their_limit(spark):
    s = one(spark, [None, 1, None, None, 4, 5, None, 8, None])
    got = impute(s, ["linear", "locf", "mean", "none"])
    assert column(got, "imp_linear") == pytest.approx([None, 1, 2, 3, 4, 5, 6.5, 8, None])
    assert column(got, "imp_locf") == [None, 1, 1, 1, 4, 5, 5, 8, None]
    assert column(got, "imp_mean")[2] == 4.5 and column(got, "imp_mean")[0] is None
    assert column(got, "imp_none") == [None, 1, None, None, 4, 5, None, 8, None]
    near = impute(s, ["linear"], max_gap=0.04)
    assert column(near, "imp_linear") == pytest.approx([None, 1, None, None, 4, 5, 6.5, 8, None])
    bench = impute(s, ["linear", "locf"], semantics="bench")
    assert column(bench, "imp_linear")[0] == 1 and column(bench, "imp_linear")[-1] == 8
    assert column(bench, "imp_locf")[0] == 1


def test_time_weighted_line(spark):
    rows = [("r", "s", 0, 0.0, 0.0), ("r", "s", 1, 3.0, None), ("r", "s", 2, 4.0, 8.0)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double"))
    assert column(impute(s, ["linear"]), "imp_linear") == [0.0, 6.0, 8.0]


def test_short_segments_and_missing_positions(spark):
    values = [float(i % 5) for i in range(8)] + [None] + [float((7 * i) % 11) for i in range(30)]
    out = smooth.smooth(one(spark, values), ["moving_median", "savgol", "butterworth"])
    for m in ("moving_median", "savgol", "butterworth"):
        got = column(out, "smo_" + m)
        assert got[:8] == values[:8] and got[8] is None and got[9:] != values[9:]
    log = smooth.settings_log(one(spark, values), "savgol").orderBy("segments", "samples").collect()
    assert {(r.status, r.segments, r.window_samples) for r in log} == {("skipped", 1, None), ("applied", 1, 21)}
    assert column(smooth.smooth(one(spark, values), ["savgol"], irregular=F.lit(True)), "smo_savgol") == values


def test_scaling_runs_before_smoothing_and_can_be_undone(table):
    s = Series.of(table)
    out = C.run_one(s, {"imputation": "linear", "scaling": "robust", "smoothing": "moving_median"}, OUTLIER_FIRST, ST)
    plain = C.run_one(s, {"imputation": "linear", "smoothing": "moving_median"}, OUTLIER_FIRST, ST)
    a, b = collected(out.df.select(*KEYS, "physical"), KEYS), collected(plain.df.select(*KEYS, "physical"), KEYS)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        C.run_one(s, {}, "smoothing_first", ST)
    with pytest.raises(ValueError):
        C.run_one(s, {"outlier": "magic"}, OUTLIER_FIRST, ST)


def test_shared_stages_equal_single_runs(table):
    """Several methods at once, a method per recording, and one by one: the same values."""
    s = Series.of(table)
    methods = {"outlier": ["none", "mad"], "imputation": ["locf", "mice"], "scaling": ["standard"], "smoothing": ["none", "savgol"]}
    for order in (OUTLIER_FIRST, IMPUTATION_FIRST):
        many = C.execute(s, methods, order, ST).df.cache()
        for o, i, m in (("mad", "locf", "savgol"), ("none", "mice", "none"), ("mad", "mice", "savgol")):
            part = many.filter((F.col("outlier") == o) & (F.col("imputation") == i) & (F.col("smoothing") == m))
            alone = C.run_one(s, {"outlier": o, "imputation": i, "scaling": "standard", "smoothing": m}, order, ST).df
            pd.testing.assert_frame_equal(collected(part.select(*KEYS, "value", "physical", "detected"), KEYS),
                                          collected(alone.select(*KEYS, "value", "physical", "detected"), KEYS), rtol=1e-9, atol=1e-9)
    use = s.on(s.df.withColumn("use_o", F.when(F.col("recording_id") == "r0", "mad").otherwise("none"))
               .withColumn("use_i", F.when(F.col("recording_id") == "r1", "mice").otherwise("locf")))
    own = C.execute(use, {"outlier": ["none", "mad"], "imputation": ["locf", "mice"]}, OUTLIER_FIRST, ST, {"outlier": "use_o", "imputation": "use_i"})
    for r, spec in (("r0", {"outlier": "mad", "imputation": "locf"}), ("r1", {"outlier": "none", "imputation": "mice"})):
        alone = C.run_one(s, spec, OUTLIER_FIRST, ST).df.filter(F.col("recording_id") == r)
        pd.testing.assert_frame_equal(collected(own.df.filter(F.col("recording_id") == r).select(*KEYS, "value"), KEYS),
                                      collected(alone.select(*KEYS, "value"), KEYS), rtol=1e-9, atol=1e-9)


def test_results_do_not_depend_on_partitions(spark):
    pdf = series_frame(12)
    runs = []
    for parts in (1, 5):
        s = Series.of(long_table(spark, pdf, parts))
        s = corrupt.nested(s.with_column("value", F.coalesce("value", F.lit(0.0))), 0.1)
        runs.append(collected(C.run_one(s, {"outlier": "iqr", "imputation": "linear", "smoothing": "butterworth"}, OUTLIER_FIRST, ST).df.select(*KEYS, "value"), KEYS))
    pd.testing.assert_frame_equal(*runs, rtol=1e-12, atol=1e-12)


def test_recordings_do_not_mix(spark):
    pdf = series_frame(13)
    alone = long_table(spark, pdf[pdf.recording_id == "r1"])
    whole = long_table(spark, pdf)
    spec = {"outlier": "zscore", "imputation": "knn", "scaling": "minmax", "smoothing": "savgol"}
    a = collected(C.run_one(Series.of(alone), spec, OUTLIER_FIRST, ST).df.select(*KEYS, "value"), KEYS)
    b = collected(C.run_one(Series.of(whole), spec, OUTLIER_FIRST, ST).df.filter("recording_id = 'r1'").select(*KEYS, "value"), KEYS)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_nested_severities(spark):
    s = one(spark, np.random.default_rng(0).normal(size=400))
    masks = {x: {r.idx for r in corrupt.nested(s, x).df.filter("mask").collect()} for x in (0.0, 0.05, 0.1, 0.15)}
    assert [len(masks[x]) for x in (0.0, 0.05, 0.1, 0.15)] == [0, 20, 40, 60]
    assert masks[0.05] < masks[0.1] < masks[0.15]


def test_corruption_counts(spark):
    s = one(spark, np.random.default_rng(1).normal(size=500))
    n = lambda kind, x: corrupt.inject(s, kind, x).df.filter("mask").count()
    assert n("mcar_missing", 0.1) == 50 and n("spikes", 0.1) == 50 and n("mcar_missing", 0.0) == 1 and n("spikes", 0.9) == 100
    assert n("drift", 0.1) == 175 and n("stuck_at", 0.1) == 50 and n("high_frequency_noise", 0.1) == 500
    assert 0 < n("block_missing", 0.1) <= 50 and 100 <= n("level_shift", 0.1) <= 400
    spikes = corrupt.inject(s, "spikes", 0.1).df.filter("mask").toPandas()
    size = abs(spikes.value - spikes.clean) / s.df.toPandas().value.std(ddof=0)
    assert size.between(4, 9).all()
    with pytest.raises(ValueError):
        corrupt.inject(s, "magic", 0.1)


def test_scores(spark):
    rows = [("r", "s", 1.0, 1.0, False), ("r", "s", 2.0, None, True), ("r", "s", 3.0, 5.0, True), ("q", "s", 1.0, None, True)]
    df = spark.createDataFrame(rows, "recording_id string, signal string, clean double, value double, mask boolean")
    got = {r.recording_id: r for r in validate.reconstruction_rmse(df, ["recording_id", "signal"]).collect()}
    assert got["r"].rmse == pytest.approx(np.sqrt(2)) and got["r"].affected_rmse == 2 and got["r"].intact_rmse == 0
    assert (got["r"].coverage, got["r"].affected_coverage, got["r"].remaining_missing, got["r"].complete) == (pytest.approx(2 / 3), 0.5, 1, False)
    assert got["q"].rmse is None and got["q"].coverage == 0
    empty = validate.detection(df.withColumn("mask", F.lit(False)).withColumn("detected", F.lit(False)), ["signal"]).first()
    assert (empty.det_precision, empty.det_recall, empty.det_f1) == (1, 1, 1)
    parts = spark.createDataFrame([(0.2, None, 0.4)], "reconstruction double, event double, retention double")
    loss = validate.weighted_loss(parts, "finance").first().loss
    assert loss == pytest.approx((0.05 * 0.2 + 0.05 * 0.4) / 0.10)


def test_only_wanted_candidates_come_back(table):
    specs = [{"outlier": "iqr", "imputation": "linear"}, {"outlier": "none", "imputation": "locf"}]
    s = Series.of(table.withColumn("value", F.coalesce("value", F.lit(0.0))))
    got = E.rmse_validation(s, specs, "mcar_missing", 0.1, ST)
    assert {(r.outlier, r.imputation) for r in got.select("outlier", "imputation").distinct().collect()} == {("iqr", "linear"), ("none", "locf")}
    assert got.filter("winner").groupBy("recording_id", "signal").count().filter("count > 1").count() == 0
    idle = E.loss_validation(s, [{}], "clipping", 0.0, "energy", ST).toPandas()
    assert (idle.retention == 0).all() and (idle.det_f1 == 0).all() and (idle.clean_harm == 0).all()
    assert idle.reconstruction.between(0, 1, inclusive="neither").all()


def test_isclose_is_scaled_by_the_second(spark):
    ask = lambda a, b: spark.range(1).select(isclose(F.lit(a).cast("double"), F.lit(b).cast("double"))).first()[0]
    assert ask(None, None) and not ask(1.0, None) and ask(1.0, 1.00001) and not ask(1.0, 1.0001)
    assert ask(0.0, 1e-9) and not ask(0.0, 1e-7)


def test_audit_is_plain_json(spark):
    import __spark_entry__ as e
    rows = e.queries()["audit_record"](spark, "/root/testdata/sf0.001").limit(2).collect()
    for r in rows:
        doc = json.loads(r.audit)
        assert doc["execution_status"] == "executed" and len(doc["feature_metrics"]) == 4
        assert 0 <= doc["quality_index_before"] <= 100 and doc["executed_pipeline"]["outlier"] == "iqr"


def test_unknown_metrics_are_features(spark):
    """Rows with a metric that isn't known count like all others."""
    from tidegauge.plans import benchmark as B
    rows = spark.createDataFrame([(i, float(i % 7), None if i % 4 == 0 else 1.0, "a" if i % 4 == 0 else "b") for i in range(60)], "seed long, f double, g double, winner string")
    got = B.holdout_accuracy(rows, ["f", "g"], F.col("seed") >= 40).first()
    assert got["rows"] == 20 and got["accuracy"] == 1.0
    assert sum(r["rows"] for r in B.grouped_cv(rows, ["f", "g"], "seed", 3).collect()) == 60 and "g" in B.rule_tree(rows, ["f", "g"])


def test_neighbours_of_small_values():
    """The nearest donors, whatever the scale of the values."""
    from tidegauge.operators import knn
    rng = np.random.default_rng(1)
    d = rng.normal(size=(200, 2)) * 1e-6
    q = rng.normal(size=(5, 2)) * 1e-6
    for row, found in zip(q, knn.nearest(q, d, np.arange(200.0), np.arange(200), 3)):
        want = np.argsort(((d - row) ** 2).sum(axis=1))[:3]
        assert [i for _, i, _, _ in sorted(found)] == want.tolist()


def test_one_irregular_recording_stays_as_it_is(spark):
    """It comes back unsmoothed, the other one smoothed."""
    from tidegauge.operators import smooth
    rows = [(r, "a", i, i / 50.0 + (0.3 * (i % 5) if r == "odd" else 0), float((i * 7919) % 13)) for r in ("odd", "even") for i in range(60)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double"))
    pdf = smooth.smooth(s, ["savgol"], irregular=F.col("recording_id") == "odd").df.toPandas()
    odd, even = pdf[pdf.recording_id == "odd"], pdf[pdf.recording_id == "even"]
    assert len(odd) == len(even) == 60 and (odd.smo_savgol == odd.value).all() and (even.smo_savgol != even.value).any()
    log = smooth.settings_log(s, "savgol", irregular=F.col("recording_id") == "odd").toPandas()
    assert dict(zip(log.recording_id, log.status)) == {"odd": "irregular", "even": "applied"}


def test_compared_methods_of_short_recordings_are_not_written(table, monkeypatch):
    """The copies per method would fill the disk; whole recordings are cleaned again instead."""
    def written(self):
        raise AssertionError("copies written")
    s = Series.of(table)
    want = C.compare_stage(s, "outlier", ["none", "iqr"], {"imputation": "linear"}, OUTLIER_FIRST, ST, "energy", 50.0).collect()
    monkeypatch.setattr(Series, "cut", written)
    got = C.compare_stage(s, "outlier", ["none", "iqr"], {"imputation": "linear"}, OUTLIER_FIRST, ST, "energy", 50.0).collect()
    assert got == want and {r["method"] for r in got} == {"none", "iqr"}


def test_stage_metrics_clean_once(table):
    """The shares and the scaled range come from one pass over the cleaned rows, as two would give them."""
    s = C.run_one(Series.of(table), {"outlier": "iqr", "imputation": "linear", "scaling": "standard"}, OUTLIER_FIRST, ST)
    out = C.stage_metrics(s, OUTLIER_FIRST)
    assert out._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
    pdf, got = s.df.toPandas(), out.toPandas().set_index("recording_id")
    for r, rows in pdf.groupby("recording_id"):
        filled = rows.after_outlier.isna() & rows.after_imputation.notna()
        assert got.imputed_fraction[r] == filled.mean() and got.outlier_affected_fraction[r] == (rows.detected & rows.raw.notna()).mean()
        assert got.remaining_missing_fraction[r] == rows.value.isna().mean()
        each = rows.groupby("signal").after_scaling
        assert got.scaled_min_median[r] == each.min().median() and got.scaled_max_median[r] == each.max().median()
        np.testing.assert_allclose(got.scaled_std_median[r], each.std(ddof=0).median())


def test_compared_methods_are_scored_in_the_tasks(table, monkeypatch):
    """Qualities from the trie are those of the profiles, and the cleaned copies are read once for all else."""
    s, args = Series.of(table), ("outlier", ["none", "zscore", "iqr", "mad", "winsorize"], {"imputation": "linear", "smoothing": "savgol"}, OUTLIER_FIRST, ST, "energy", 50.0)
    monkeypatch.setattr(C, "_walked_quality", lambda *a: None)
    want = C.compare_stage(s, *args).toPandas().sort_values(["recording_id", "method"]).reset_index(drop=True)
    monkeypatch.undo()
    monkeypatch.setattr(C, "profile_with_corr", None)
    got = C.compare_stage(s, *args)
    assert got._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 2
    got = got.toPandas().sort_values(["recording_id", "method"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)


def test_a_chunk_goes_to_its_own_filter(table, monkeypatch):
    """Where a column names the method of each recording, its samples reach no other filter, and the values are as before."""
    methods = ["none", "savgol", "butterworth"]
    by = F.when(F.col("recording_id") == "r0", "savgol").when(F.col("recording_id") == "r1", "butterworth").otherwise("none")
    s = Series.of(table.withColumn("use", by))
    alone = {m: collected(smooth.smooth(Series.of(table), [m]).df, KEYS) for m in methods}
    out = collected(smooth.smooth(s, methods, only="use").df, KEYS)
    for m in methods:
        mine = (out.use == m).to_numpy()
        assert mine.any()
        np.testing.assert_array_equal(out.loc[mine, "smo_" + m], alone[m].loc[mine, "smo_" + m])
    others = out.loc[(out.use != "savgol").to_numpy(), "smo_savgol"]
    assert others.isna().all()


def test_layout_outlasts_a_cut(spark):
    """What is written in place is grouped by its key, and more, without another shuffle."""
    df = spark.range(100).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("x"), "id").repartition(5, "k")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    out = cut_in_place(df).groupBy("k", "x").agg(F.sum("id").alias("s"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.groupBy("k", "x").agg(F.sum("id")).collect()))


def test_row_medians_equal_the_filter_and_stay_in_place(spark, table):
    """Segments of 1 to 30 samples, cut by gaps and by times, with irregular rows; no second shuffle and no Python."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for r, lengths in enumerate(([30, 9, 1, 8, 12], [10], [3, 25])):
        idx, t = 0, 0.0
        for n in lengths:
            x = np.round(rng.normal(size=n), 1)
            rows += [(f"r{r}", "a", idx + i, t + i, float(v), r == 1) for i, v in enumerate(x)]
            want |= {(f"r{r}", idx + i): v for i, v in enumerate(smooth.moving_median(x) if n >= 9 and r != 1 else x)}
            if n == 12 or n == 1:  # a gap in time alone
                idx, t = idx + n, t + n + 50
            else:
                rows += [(f"r{r}", "a", idx + n, t + n, None, r == 1)]
                idx, t = idx + n + 1, t + n + 1
    s = Series.of(spark.createDataFrame(rows, "recording_id string, signal string, idx long, t double, value double, odd boolean").repartition(3))
    out = smooth.smooth(s, ["none", "moving_median"], 5.0, F.col("odd")).df
    got = {(r.recording_id, r.idx): (r.smo_none, r.smo_moving_median) for r in out.collect()}
    assert len(got) == len(rows)
    for k, (plain, median) in got.items():
        assert median == want.get(k) and (plain is None) == (k not in want)
    again = out.groupBy("recording_id", "signal").agg(F.max("smo_moving_median"))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
