"""Reading, column roles, clocks, validity flags and recording detection on small tables."""

import pytest
from pyspark.sql import functions as F

from tidegauge.domains import full_grid
from tidegauge.functions.series import Series
from tidegauge.operators import columns as M
from tidegauge.operators import timeaxis as T
from tidegauge.operators import validity as V
from tidegauge.plans import recommend as R
from tidegauge.sources import blocks as B
from tidegauge.sources import delimited as D


def indexed(spark, rows, schema, keys="r string"):
    return Series.of(spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], f"recording_id string, idx long, {schema}"), ("recording_id",))


def test_labels_stay_text_and_numbers_are_read(spark):
    df = spark.createDataFrame([("50", 100.0, "100"), ("52", 120.0, "120"), ("Unidentified(Neg)", 140.0, "-"), ("Unidentified(Pos)", 160.0, "130"), ("49", 180.0, "125")],
                               "Participant string, `RecordingTime [ms]` double, gaze_x string")
    out = M.promote(df)
    assert dict(out.dtypes) == {"Participant": "string", "RecordingTime [ms]": "double", "gaze_x": "double"}
    assert out.filter("gaze_x is null").count() == 1
    assert [r.Participant for r in out.collect()][2] == "Unidentified(Neg)"


def test_number_formats(spark):
    texts = ["1 234,5", "1 000", "12%", "7px", "3e2", "abc", " NA ", "#VALUE!", "-", "", "-4.5kg"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(M.as_number(F.col("x"))).collect()]
    assert got == [1234.5, 1000.0, 12.0, 7.0, 300.0, None, None, None, None, None, -4.5]
    assert M.promotable(df)["x"]  # six of the seven that are not missing
    assert not M.promotable(df, 0.9)["x"]


def blocks_of(spark, ids):
    s = indexed(spark, [(x, 20 * i) for i, x in enumerate(ids)], "Participant string, `RecordingTime [ms]` long")
    return [(r.label, r.stop - r.start) for r in B.detect_blocks(s, ["Participant", "RecordingTime [ms]"]).orderBy("start").collect()]


def test_recording_blocks(spark):
    assert blocks_of(spark, ["50"] * 200 + ["52"] * 220 + ["50"] * 230) == [("50", 200), ("52", 220), ("50", 230)]
    assert blocks_of(spark, ["50"] * 200) == []
    assert blocks_of(spark, [str(i) for i in range(200)]) == []
    assert blocks_of(spark, [None] * 60 + ["a"] * 60) == [("(unknown)", 60), ("a", 60)]
    assert blocks_of(spark, (["a"] * 5 + ["b"] * 5) * 10) == []


def test_finest_recording_column_wins(spark):
    rows = [("A" if i < 80 else "B", ("one", "two", "three")[i // 40], i % 40) for i in range(120)]
    s = indexed(spark, rows, "`Participant name` string, `Recording name` string, clock long")
    got = B.detect_blocks(s, ["Participant name", "Recording name", "clock"]).orderBy("start").collect()
    assert [r.column for r in got] == ["Recording name"] * 3
    assert [(r.start, r.stop) for r in got] == [(0, 40), (40, 80), (80, 120)]
    assert B.select_block(s, 40, 80).df.agg(F.min("idx"), F.max("idx")).first() == (0, 39)
    with pytest.raises(ValueError):
        B.select_block(s, 5, 5)
    split = B.with_blocks(s, "Recording name").df.groupBy("recording_id").count().collect()
    assert sorted(r["count"] for r in split) == [40, 40, 40]


@pytest.mark.parametrize("name,unit", [
    ("time [us]", "microseconds"), ("Microclock", "microseconds"), ("t_ns", "nanoseconds"), ("RecordingTime [ms]", "milliseconds"),
    ("minute", "minutes"), ("time_min", "minutes"), ("hours", "hours"), ("time_h", "hours"), ("days", "days"), ("t_d", "days"),
    ("elapsed s", "seconds"), ("time (sec)", "seconds"), ("timestamp", None), ("time", None)])
def test_unit_from_name(spark, name, unit):
    assert spark.range(1).select(T.unit_from_name(F.lit(name))).first()[0] == unit


def test_preferred_clock(spark):
    s = indexed(spark, [(i, 20 * i) for i in range(5)], "timestamp long, `RecordingTime [ms]` long")
    unknown = F.lit(None).cast("double")
    got = T.preferred_clock(s, {"timestamp": unknown, "RecordingTime [ms]": F.col("`RecordingTime [ms]`") * 1e-3}).first()
    assert (got["column"], got.valid) == ("RecordingTime [ms]", True)
    only = T.preferred_clock(s, {"timestamp": unknown}).first()
    assert (only["column"], only.valid) == ("timestamp", False)
    assert M.likely_time_columns(["Unnamed: 0", "gaze_x"]) == []
    rate = T.sampling_rate(s, "timestamp", T.unit_scale(T.unit_from_name(F.lit("timestamp")))).first()
    assert rate.rate_hz is None and "ambiguous" in rate.reason


def test_dates_and_numbers_as_clocks(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01.5",), ("oops",), ("2024-01-01 00:00:03",)], "time string")
    out = T.parse_clock(df, "time").collect()
    assert all(r.is_date for r in out)
    assert [None if r.clock is None else r.clock - out[0].clock for r in out] == [0.0, 1.5, None, 3.0]
    num = T.parse_clock(spark.createDataFrame([("1.5",), ("x",), ("inf",), ("2",), ("3",)], "time string"), "time").collect()
    assert [r.clock for r in num] == [1.5, None, None, 2.0, 3.0] and not num[0].is_date
    s = indexed(spark, [(1e15 + 10.0 * i,) for i in range(4)], "clock double")
    assert [r.t for r in T.relative_seconds(s, "clock", F.lit(1e-6)).df.orderBy("idx").collect()] == pytest.approx([0, 1e-5, 2e-5, 3e-5])


def test_gate_and_diagnostics(spark):
    rows = [("ok", i, 0.02 * i) for i in range(50)] + [("dup", i, 0.02 * (i // 2)) for i in range(50)] + [("back", i, 0.02 * (i % 30)) for i in range(50)]
    rows += [("gap", i, None if i == 7 else 0.02 * i) for i in range(50)] + [("odd", i, 0.02 * i + (0.5 if i > 20 else 0)) for i in range(50)] + [("one", 0, 0.0)]
    s = Series.of(spark.createDataFrame(rows, "recording_id string, idx long, t double"), ("recording_id",))
    d = {r.recording_id: r for r in T.diagnostics(s).collect()}
    assert d["ok"].valid and not d["ok"].irregular_intervals and d["ok"].sampling_rate_hz == pytest.approx(50)
    assert (d["dup"].valid, d["dup"].duplicate_steps) == (False, 25)
    assert (d["back"].valid, d["back"].backward_steps) == (False, 1)
    assert (d["gap"].valid, d["gap"].missing_timestamps, d["gap"].duration_seconds) == (False, 1, None)
    assert d["odd"].valid and d["odd"].irregular_intervals
    assert not d["one"].valid
    good, bad = T.gate(s.df, T.diagnostics(s), s.groups)
    assert {r[0] for r in good.select("recording_id").distinct().collect()} == {"ok", "odd"}
    assert good.count() + bad.count() == len(rows)


def test_quantised_clock(spark):
    steps = [1, 1, 2, 1, 2, 1, 2] * 600
    t, rows = 0, []
    for i, x in enumerate(steps):
        t += x
        rows.append(("r", i, t / 1000.0))
    s = Series.of(spark.createDataFrame(rows, "recording_id string, idx long, t double"), ("recording_id",))
    d = T.diagnostics(s).first()
    assert 650 < d.sampling_rate_hz < 900 and "quantised" in d.sampling_rate_estimation


def test_unit_guidance(spark):
    n = 200
    s = indexed(spark, [(8333.0 * i, float(int(199 * 8.333))) for i in range(n)], "clock double, duration double")
    got = T.unit_guidance(s, "clock", ["Recording timestamp", "Gaze point X"], "Recording timestamp", "duration").first()
    assert (got.unit, got.confidence) == ("microseconds", "verified")
    assert T.unit_guidance(s, "clock", ["time", "temperature"], "time").count() == 0
    assert T.unit_guidance(s, "clock", ["gaze"], "RecordingTime [ms]").count() == 0
    assert T.unit_guidance(s, "clock", ["gaze", "time"], "time").first().confidence == "unverified"


def test_gaze_stream_and_flags(spark):
    df = spark.createDataFrame([("Eye Tracker", 100, 1.0), ("Mouse", 100, None), ("Eye Tracker", 101, 2.0)], "Sensor string, clock long, `Gaze point X` double")
    assert [r.clock for r in V.gaze_rows(df).collect()] == [100, 101]
    assert V.gaze_rows_log(df).first() == (2, 1)
    f = spark.createDataFrame([(0, 20, 2, 0), (1, -32768, -32768, 1), (2, 25, 4, 0)], "time int, x int, y int, missing int")
    out = V.flag_validity(f, ["x", "y"], missing_flag=True).collect()
    assert [(r.time, r.x, r.y) for r in out] == [(0, 20, 2), (1, None, None), (2, 25, 4)]
    log = V.flag_validity_log(f, ["x", "y"], missing_flag=True).collect()
    assert [(r.signal, r.flagged_rows, r.new_missing) for r in log] == [("x", 1, 1), ("y", 1, 1)]
    assert "missing" not in M.numeric_signals(f)


def test_paired_zeros(spark):
    g = spark.createDataFrame([(0, 0), (0, 4), (10, 5)], "gaze_x_left int, gaze_y_left int")
    assert V.paired_zeros(g).first() == ("gaze_x_left", "gaze_y_left", 1)
    out = V.mask_paired_zeros(g, ["gaze_x_left"]).collect()
    assert [(r[0], r[1]) for r in out] == [(None, 0), (0, 4), (10, 5)]
    assert V.gaze_pairs(["Gaze X", "Gaze Y", "Point of Regard Left X [px]", "Point of Regard Left Y [px]", "Gaze Right X (mm)", "speed x"]) == [
        ("Gaze X", "Gaze Y"), ("Point of Regard Left X [px]", "Point of Regard Left Y [px]")]


def test_domain_and_signal_order(spark):
    cols = M.column_table(spark, ["timestamp", "cpu", "latency", "traffic load"])
    assert M.infer_domain(cols, ["cpu"]).first().domain == "network"
    assert M.infer_domain(M.column_table(spark, ["a", "b"]), []).first().domain == "eye_tracking"
    assert [r.name for r in M.ranked_signals(M.column_table(spark, ["pupil", "Gaze Point Y", "other", "gaze point x"]), "eye_tracking").collect()] == [
        "gaze point x", "Gaze Point Y", "pupil", "other"]
    assert [r.name for r in M.time_candidates(M.column_table(spark, ["Recording timestamp", "x", "Date", "o'clock"])).orderBy("position").collect()] == [
        "Recording timestamp", "Date", "o'clock"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 1.0, None), (3.0, 3.0, 4.0, 3.0, 3.0)], "a double, b double, c double, d double, e double")
    assert M.duplicate_groups(df, list("abcde")) == [["a", "b", "d"]]
    assert M.default_signals(df, list("abcde")) == ["a", "c", "e"]
    assert M.default_signals(df, list("abcde"), 2) == ["a", "c"]


def test_dialects_and_reading(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("\ufefftime; x ;Participant\n" + "".join(f"{i};{i},5;50\n" for i in range(40)), encoding="utf-8")
    (tmp_path / "f" / "b.csv").write_text("time,x\n" + "".join(f"{i},{i}.5\n" for i in range(40)))
    (tmp_path / "f" / "c.tsv").write_text("time\tx\n1\t2\n")
    (tmp_path / "f" / "d.csv").write_bytes("time|größe\n1|2\n".encode("latin-1"))
    got = {r.file.rsplit("/", 1)[1]: (r.encoding, r.separator, r.decimal) for r in D.dialects(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.csv": ("utf-8-sig", ";", ","), "b.csv": ("utf-8-sig", ",", "."), "c.tsv": ("utf-8-sig", "\t", "."), "d.csv": ("latin-1", "|", ".")}
    df = D.read_delimited(spark, str(tmp_path / "f" / "a.csv"))
    assert df.columns[:3] == ["time", "x", "Participant"]
    assert dict(df.dtypes)["Participant"] == "string" and df.agg(F.sum("x")).first()[0] == sum(i + 0.5 for i in range(40))
    again = D.read_delimited(spark, str(tmp_path / "f" / "a.csv"), separator="|")
    assert again.columns[:3] == ["time", "x", "Participant"]


def test_mixed_folder(spark, tmp_path):
    """Each file is read in its own dialect and encoding, by column name; the unreadable ones have a status."""
    (tmp_path / "m x").mkdir()
    put = lambda n, b: (tmp_path / "m x" / n).write_bytes(b)
    put("a.csv", "time;größe\n".encode("latin-1") + b"".join(b"%d;%d,5\n" % (i, i) for i in range(30)))
    put("b.csv", "größe,time,more\n".encode() + b"".join(b"%d.25,%d,z\n" % (i, i) for i in range(30)))
    put("c.csv", b"\n \n")
    put("d.csv", b"alone\n1\n2\n")
    df = D.read_delimited(spark, str(tmp_path / "m x"))
    assert df.count() == 60 and set(df.columns) == {"time", "größe", "more", "source", "row"}
    assert df.agg(F.sum("größe"), F.count("more"), F.sum("time")).first()[:] == (30 * 0.75 + 2 * 435, 30, 870.0)
    assert {r.file.rsplit("/", 1)[1]: r.status for r in D.layouts(spark, str(tmp_path / "m x")).collect()} == {
        "a.csv": "ok", "b.csv": "ok", "c.csv": "empty", "d.csv": "single column"}


def test_candidate_lists(spark):
    grid = [tuple(r) for r in R.spec_grid(spark).orderBy("pipeline_id").select("order", "imputation", "outlier", "smoothing", "scaling").collect()]
    assert grid == full_grid() and len(grid) == 336
    pilot = R.pilot_subset(R.spec_grid(spark)).collect()
    assert len(pilot) == 25 and (pilot[0].imputation, pilot[0].outlier, pilot[0].smoothing) == ("linear", "none", "none")
    rows = spark.createDataFrame([("iqr", "linear", None), ("iqr", "linear", "none"), (None, "", None), ("", "locf", "savgol")], "outlier string, imputation string, smoothing string")
    got = sorted(tuple(r) for r in R.candidate_table(rows).collect())
    assert got == [("iqr", "linear", "none", "none"), ("none", "locf", "savgol", "none")]
    with pytest.raises(Exception, match="choose an available method"):
        R.candidate_table(spark.createDataFrame([("magic", "linear", None)], rows.schema)).collect()


def profile_row(spark, **over):
    from tidegauge.operators.profile import METRICS
    base = {m: 0.1 for m in METRICS} | {"max_" + m: 0.1 for m in METRICS} | {"n": 500.0, "skewness": 0.0} | over
    domain = base.pop("domain", "energy")
    flag = base.pop("resampling", False)
    df = spark.createDataFrame([("r", domain, flag, *[None if v is None else float(v) for v in base.values()])],
                               "recording_id string, domain string, smoothing_requires_resampling boolean, " + ", ".join(f"{k} double" for k in base))
    return {r.stage: r for r in R.recommend(df).collect()}


def test_rules_and_guards(spark):
    r = profile_row(spark)
    assert (r["imputation"].method, r["outlier"].method, r["smoothing"].method, r["scaling"].method) == ("linear", "zscore", "savgol", "robust")
    assert r["imputation"].rule_trace[0] == "n=500 > 182.5"
    assert profile_row(spark, missing_rate=0)["imputation"].method == "none"
    assert profile_row(spark, n=100)["imputation"].method == "mean"
    assert profile_row(spark, longest_missing_run_seconds=1, missing_burstiness=0.2)["imputation"].method == "locf"
    r = profile_row(spark, domain="finance")
    assert [r[s].method for s in ("outlier", "smoothing", "scaling")] == ["none"] * 3
    assert profile_row(spark, kurtosis_excess=9, outlier_mad_rate=0.001)["outlier"].method == "none"
    assert profile_row(spark, spectral_entropy=None, max_outlier_iqr_rate=0.01)["outlier"].method == "iqr"
    assert profile_row(spark, spectral_entropy=0.9)["outlier"].method == "winsorize"
    r = profile_row(spark, resampling=True, domain="eye_tracking")["smoothing"]
    assert r.method == "none" and "resampling" in r.caution and len(r.domain_support) == 4
    assert profile_row(spark, max_local_volatility=0.6)["smoothing"].method == "none"
    assert profile_row(spark, skewness=0.2)["smoothing"].method == "butterworth"
    assert profile_row(spark, dominant_frequency_ratio=0.6)["smoothing"].method == "moving_median"
