"""Worked examples and equivalences of the time-series operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.operators import blocks, clock, events, models, scores, segments, stats
from pulsegrid.sources import logs


def test_log_lines(spark):
    text = """rts:1002 sts:1000  t:STIMULUSEVENT ts:990 v[2]:{0,1}{5,-1} <-/127.0.0.1:4000
rts:1012 sts:1010  t:DATAPACKET ts:1000 v[2x3]:[1.0,2.0,][3.0,4.0,][5.0,6.0,] <-/127.0.0.1:4001
rts:1022 sts:1020  t:NEWTARGET ts:1011 <-/127.0.0.1:4000
rts:1032 sts:1030  t:MODECHANGE ts:1021 mode:Calibrate.supervised <-/127.0.0.1:4000
rts:1042 sts:1040  t:DATAHEADER ts:1031 fs250.0 ch[2]:Cz,Pz <-/127.0.0.1:4001
rts:1052 sts:1050  t:HEARTBEAT ts:1041 v:NULL <-/127.0.0.1:4001"""
    m = logs.parse_log(spark.createDataFrame([("s", x) for x in text.split("\n")], "session string, value string"))
    assert m.count() == 5 and {r.client for r in m.collect()} == {"/127.0.0.1:4000", "/127.0.0.1:4001"}
    assert sorted((r.ts, r.obj, r.state) for r in logs.parse_stimulus(m).collect()) == [(1000, 0, 1), (1000, 5, 255)]
    assert [r.samples for r in logs.parse_packets(m).collect()] == [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]]
    assert sorted((r.kind, r.mode) for r in logs.parse_markers(m).collect()) == [("MODECHANGE", "Calibrate.supervised"), ("NEWTARGET", None)]
    assert [(r.fs, r.labels) for r in logs.parse_headers(m).collect()] == [(250.0, ["Cz", "Pz"])]


def test_unwrap(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([10, 1000, 5, 900, 3])], "k string, i long, ts long")
    got = [r.unwrapped for r in clock.unwrap_ts(df, ["k"], ["i"]).orderBy("i").collect()]
    assert got == [10, 1000, 1029, 1924, 2051]


@pytest.mark.parametrize(
    ("evt", "a", "b"),
    [("re", [2, 8], [3, 5, 8, 11]), ("fe", [4, 12], [4, 6, 9, 12]), ("diff", [2, 4, 8, 12], [3, 4, 5, 6, 8, 9, 11, 12]), ("onset", [2], [3, 4]), ("ntre", [3, 5, 11], [2]), ("rest", [0, 1, 4, 6, 7, 12], [0, 1, 4, 6, 7, 12])],
)
def test_event_coding(spark, evt, a, b):
    rows = [(0, s, int(x)) for s, x in enumerate("0011000011110")] + [(1, s, int(x)) for s, x in enumerate("0001010010010")]
    df = spark.createDataFrame([("t", *r) for r in rows], "trial string, obj long, samp long, level int")
    got = {(r.obj, r.samp) for r in events.code_events(df, [evt], ["trial"]).where("v = 1").collect()}
    assert sorted(s for o, s in got if o == 0) == a and sorted(s for o, s in got if o == 1) == b


def test_as_of_upsample(spark):
    samples = spark.createDataFrame([("s", 10 * i, i) for i in range(6)], "session string, ts long, samp long")
    stim = spark.createDataFrame([("s", 12, 0, 1), ("s", 33, 0, 0)], "session string, ts long, obj long, state int")
    got = [r.level for r in segments.upsample_stimulus(samples, stim, ["session"]).orderBy("samp").collect()]
    assert got == [0, 1, 1, 0, 0, 0]


def test_segment_slice(spark):
    samples = spark.createDataFrame([("s", 10 * i) for i in range(5)], "session string, ts long")
    seg = spark.createDataFrame([("s", 7, 15, 35)], "session string, seg long, bgn long, end long")
    assert sorted(r.ts for r in segments.slice_segments(samples, seg, ["session"], width=12).collect()) == [10, 20, 30]


def test_markers_to_trials(spark):
    m = [(5, "SELECTION"), (10, "NEWTARGET"), (20, "SELECTION"), (25, "NEWTARGET"), (40, "MODECHANGE")]
    df = spark.createDataFrame([("s", i, t, k) for i, (t, k) in enumerate(m)], "session string, seq long, ts long, kind string")
    assert sorted((r.bgn, r.end) for r in segments.trials_from_markers(df, ["session"]).collect()) == [(10, 20), (20, 25), (25, 40)]


def test_windowed_minimum_offset(spark):
    y = [*range(1, 11), 9, 8]
    df = spark.createDataFrame([("c", i, x, v) for i, (x, v) in enumerate(zip(range(12), y, strict=True))], "client string, seq long, x long, y long")
    got = [r.offset for r in clock.windowed_offset(df, ["client"], "x", "y", F.lit(True), "seq", window=5).orderBy("seq").collect()]
    assert got == [1] * 10 + [-1, -3]


def test_decision_points(spark):
    assert scores.decision_points(5, -2) == [1, 3, 4] and scores.decision_points(10, 2) == [2, 4, 8, 9] and scores.decision_points(7, 0) == [6]
    n = spark.createDataFrame([(1, 10)], "trial long, n long")
    assert sorted(r.samp for r in scores.decision_grid(n, least=2).collect()) == [2, 4, 8, 9]


def test_softmax(spark):
    z = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.5), (0, 2, 0.5)], "trial long, obj long, z double").withColumn("samp", F.lit(0))
    z = z.withColumn("z", F.when(F.col("obj") > 0, 1e-12).otherwise(F.col("z")))
    got = [round(r.p, 5) for r in scores.target_probs(z, ["trial", "samp"]).orderBy("obj").collect()]
    assert got == [0.78699, 0.10651, 0.10651]


def test_press_release(spark):
    from pulsegrid.streaming import streams

    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([0.5, 0.08, 0.05, 0.3, 0.09])], "session string, ts long, perr double")
    assert [r.fired for r in streams.press_release(df, ["session"], ["ts"]).orderBy("ts").collect()] == [0, 1, 0, 0, 1]


def test_filter_blocks_meet_the_whole():
    rng = np.random.default_rng(0)
    x, sos = rng.standard_normal((200, 3)) + 5, filters.butter_sections(4, (0, 2), 100.0)
    system = blocks.Linear.sections(sos)
    state = system.steady(x[0])
    whole, _ = system.run(x, state)
    parts = []
    for k in range(0, 200, 37):
        y, state = system.run(x[k : k + 37], state)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole)


@pytest.mark.parametrize(("kind", "band", "passed", "stopped"), [("lowpass", (10.0,), 2.0, 40.0), ("highpass", (20.0,), 40.0, 2.0), ("bandpass", (8.0, 15.0), 11.0, 35.0), ("bandstop", (8.0, 15.0), 35.0, 11.0)])
def test_butterworth_gain(kind, band, passed, stopped):
    sos = filters.butter_sections(4, band, 100.0, kind)
    gain = lambda f: abs(np.prod([np.polyval(s[:3], z := np.exp(2j * np.pi * f / 100)) / np.polyval(s[3:], z) for s in sos]))
    assert abs(gain(passed) - 1) < 0.05 and gain(stopped) < 0.05
    assert abs(gain(band[0]) - 2**-0.5) < 0.01


def synthetic(spark, n_trials=6, n=120, noise=0.5, seed=1):
    """Object 0 drives the signal through a known response; other objects do not."""
    rng = np.random.default_rng(seed)
    response, w = np.array([0.0, 1.0, 0.5, -0.5]), np.array([1.0, -0.5, 0.25])
    sig, ev = [], []
    for t in range(n_trials):
        y = (rng.random((5, n)) < 0.2).astype(float)
        drive = np.convolve(y[0], response)[:n]
        x = drive[:, None] * w + noise * rng.standard_normal((n, 3))
        sig += [("s", t, i, c, float(x[i, c])) for i in range(n) for c in range(3)]
        ev += [("s", t, i, o, "re", float(y[o, i])) for o in range(5) for i in range(n) if y[o, i]]
    return spark.createDataFrame(sig, "session string, trial int, samp int, ch int, v double"), spark.createDataFrame(ev, "session string, trial int, samp int, obj long, evt string, v double")


def test_fit_finds_the_response(spark):
    s, e = synthetic(spark)
    t = models.summary_stats(s, e, ["session", "trial"], ["session"], 4)
    full = {(r.lag, r.ch): r.w for r in models.factored_to_full(models.fit_cca(t, ["session"], 4, reg_x=1e-3, reg_y=1e-3), ["session"]).collect()}
    space = np.array([sum(full[(lag, c)] for lag in (1, 2)) for c in range(3)])
    assert np.argmax([abs(full[(lag, 0)]) for lag in range(4)]) == 1 and space[0] > 0 > space[1]
    fwd = {(r.k, r.idx): r.v for r in models.fit_forward(t, ["session"], 4).collect()}
    assert abs(fwd[(0, 1)] - 1.0) < 0.15 and abs(fwd[(1, 1)] + 0.5) < 0.15


def test_cross_validated_score(spark):
    s, e = synthetic(spark)
    score = models.cross_validate(s, e, ["session"], 4, 3, [1])[1].first().score
    assert score > 0.8
    blind = s.withColumn("v", F.randn(3))
    assert models.cross_validate(blind, e, ["session"], 4, 3, [1])[1].first().score < 0.6


def test_covariances_meet_numpy(spark):
    s, e = synthetic(spark, 2, 40)
    x = np.zeros((2, 40, 3))
    for r in s.collect():
        x[r.trial, r.samp, r.ch] = r.v
    y = np.zeros((2, 40))
    for r in e.where("obj = 0").collect():
        y[r.trial, r.samp] = r.v
    got = {(r.lag, r.ch): r.v for r in stats.cov_xy(s, e.where("obj = 0"), ["session", "trial"], ["session"], 4).collect()}
    for lag in range(4):
        for c in range(3):
            assert abs(got.get((lag, c), 0) - sum((y[t, k] * x[t, k + lag, c]) for t in range(2) for k in range(37))) < 1e-9
    auto = {(r.lag, r.d1, r.d2): r.v for r in stats.autocov_xx(s, ["session", "trial"], ["session"], 3).collect()}
    assert abs(auto[(2, 0, 1)] - sum(x[t, k + 2, 0] * x[t, k, 1] for t in range(2) for k in range(38))) < 1e-9


def test_clock_trackers_follow_a_drift(spark):
    rng = np.random.default_rng(2)
    rows = [("c", i, 100 * i, int(100.1 * i + 50 + rng.exponential(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "client string, i long, x long, y long")
    for fn in (clock.exp_weighted_clock, clock.lower_bound_clock):
        last = fn(df, ["client"], ["i"], "x", "y").orderBy(F.desc("i")).first()
        assert abs(last.aligned - (100.1 * 299 + 50)) < 15


def test_stream_code_meets_batch(spark, small):
    import duckdb

    from pulsegrid.jobs import more_queries, queries

    del more_queries
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{small}/events.parquet')")
    want = sorted(duckdb.sql("SELECT session, obj, samp, v FROM (" + queries.SQL["stream_code"] + ")").fetchall())
    got = queries.QUERIES["stream_code"](spark, small).select("session", "obj", "samp", "v").collect()
    assert len(want) == 1000 and sorted(map(tuple, got)) == want


def test_queries_have_names_in_both(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
