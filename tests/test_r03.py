"""Findings of round 3: plans that stay small, and values on odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.operators import clock, scores, segments
from pulsegrid.sources import logs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


FY = [(t, o, s, float((t * 7 + o * 3 + s * 5) % 11 - 5)) for t in range(3) for o in range(3) for s in range(6)]


def fy(spark):
    return spark.createDataFrame(FY, "trial long, obj long, samp long, v double")


def test_calibration_makes_no_row_a_scale(spark):
    z = fy(spark).withColumnRenamed("v", "z")
    got = scores.calibrate_softmax(z, ["trial", "samp"], [0.1, 0.5, 2.0, -1.0])
    assert "Generate" not in plan(got)
    losses = {}
    for scale in (0.1, 0.5, 2.0, -1.0):
        total = 0.0
        for t in range(3):
            for s in range(6):
                row = {o: v for tt, o, ss, v in FY if (tt, ss) == (t, s)}
                top = max(scale * v for v in row.values())
                e = {o: math.exp(scale * v - top) for o, v in row.items()}
                total -= math.log(max(e[0] / sum(e.values()), 1e-5))
        losses[scale] = round(total, 6)
    best = min(losses, key=losses.get)
    row = got.first()
    assert row["scale"] == best and row["loss"] == pytest.approx(losses[best], abs=1e-5)


def test_calibration_with_nan_and_silent_outputs(spark):
    z = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 1, float("nan")), (0, 1, 1, 0.0), (1, 0, 0, 0.0), (1, 1, 0, 3.0)], "trial long, obj long, samp long, z double")
    # output 1 of trial 0 has no score, so output 0 is certain; the NaN sample counts as 1e-5; trial 1 has no true score
    row = scores.calibrate_softmax(z, ["trial", "samp"], [2.0]).first()
    assert row["loss"] == pytest.approx(-math.log(1e-5), abs=1e-5)


def test_scores_are_dealt_by_trial_once(spark):
    """Running sums, noise and probabilities take one shuffle by trial each, not one an operation."""
    assert plan(scores.cumulative_scores(fy(spark), ["trial"])).count("Exchange") == 1
    assert plan(scores.audc_score(fy(spark), ["trial"], ["trial"])).count("Exchange") == 1
    p = scores.target_probs(fy(spark).withColumnRenamed("v", "z"), ["trial", "samp"])
    assert plan(p).count("Exchange") == 1
    assert plan(scores.entropy(p, ["trial", "samp"])).count("Exchange") == 1
    assert plan(scores.combine_probs(p, ["trial"])).count("Exchange") == 1
    assert plan(scores.select_output(p, ["trial", "samp"])).count("Exchange") == 1


def test_absent_scores_before_between_and_after_count_as_zero(spark):
    d = spark.createDataFrame([(0, 0, 2, 1.0), (0, 0, 5, 2.0), (0, 1, 7, 3.0), (0, 2, 0, None), (1, 4, 0, 5.0)], "trial long, obj long, samp long, v double")
    got = {(r["trial"], r["obj"], r["samp"]): (r["v"], r["s"], r["n"], r["ny"]) for r in scores.cumulative_scores(d, ["trial"]).collect()}
    assert len(got) == 3 * 8 + 1
    assert got[0, 0, 1] == (0.0, 0.0, 0, 2) and got[0, 0, 7] == (0.0, 3.0, 3, 2) and got[0, 2, 6] == (0.0, 0.0, 2, 2)
    assert got[0, 1, 7] == (3.0, 3.0, 3, 2) and got[1, 4, 0] == (5.0, 5.0, 1, 1)


def recording(spark, trials=5, n=40):
    rng = np.random.default_rng(3)
    rows = [(g, t, s, rng.normal(size=3).tolist()) for g in range(2) for t in range(trials) for s in range(-2, n - 2 - (t == 1) * 7)]
    return rows, spark.createDataFrame(rows, "session long, trial int, samp long, x array<double>")


def test_spectra_join_trials_not_samples(spark):
    rows, d = recording(spark)
    got = {(r["session"], r["trial"], r["samp"]): r["x"] for r in filters.spectral_whiten(d, ["session"]).collect()}
    assert len(got) == len(rows)
    for g in range(2):
        spectra = {t: np.fft.fft([x for gg, tt, _, x in rows if (gg, tt) == (g, t)], axis=0) for t in range(5)}
        for t, f in spectra.items():
            h = np.mean([np.abs(o) for o in spectra.values() if len(o) == len(f)], axis=0)
            want = np.real(np.fft.ifft(f / (h + h.max() * 0.01), axis=0))
            assert np.allclose([got[g, t, s - 2] for s in range(len(f))], want)
    joined = filters.spectral_whiten(d, ["session"])._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join") == 1 and "rows#" in joined.split("Join")[1]


def test_powers_and_predictors_in_strides(spark):
    x = np.random.default_rng(1).normal(size=(200, 3))
    a, b = filters.PowerTracker(20.0, 50.0, car=False), filters.PowerTracker(20.0, 50.0, car=False)
    got = np.concatenate([a.run(x[:70]), a.run(x[70:71]), a.run(x[71:])])
    b.sums = np.zeros((2, 3))
    want = []
    for v in x:
        keep = np.array([b.keep_mean, b.keep])
        b.counts, b.sums = keep * b.counts + 1, keep[:, None] * b.sums
        b.sums[0] += v
        b.sums[1] += np.square(v - b.sums[0] / b.counts[0])
        want.append(b.power())
    assert np.allclose(got, want, rtol=1e-12) and np.allclose(a.flat(), b.flat(), rtol=1e-12)
    p = filters.Predictor(4, 3)
    parts = np.concatenate([p.learn(0, x[:3], 0.01), p.learn(0, x[3:90], 0.01), p.learn(0, x[90:], 0.01)])
    weights, power = np.eye(4, 1, -3) * np.ones(3), np.ones(3)
    for t in range(200):
        guess = np.zeros(3)
        if t >= 4:
            guess = (weights * x[t - 4 : t]).sum(0)
            power = power + 0.01 * (x[t] ** 2 - power)
            weights = weights + x[t - 4 : t] * (0.01 * (x[t] - guess) / power)
        assert np.allclose(parts[t], guess, rtol=1e-10)
    assert np.allclose(p.weights, weights) and np.allclose(p.power, power)


def test_keys_of_one_block_are_not_joined(spark):
    _, d = recording(spark)
    d = d.where("samp >= 0")
    y = filters.iir_filter(d, ["session", "trial"], 100.0, [(0, 2)])
    assert "Join" not in plan(y)
    cut_up = filters.iir_filter(d, ["session", "trial"], 100.0, [(0, 2)], size=8)
    key = lambda r: (r["session"], r["trial"], r["samp"])
    for a, b in zip(sorted(y.collect(), key=key), sorted(cut_up.collect(), key=key), strict=True):
        assert key(a) == key(b) and np.allclose(a["x"], b["x"])


@pytest.mark.parametrize("how", ["min", "max"])
def test_trailing_offsets_without_frames_of_rows(spark, how):
    rng = np.random.default_rng(5)
    rows = [(c, k, int(x), int(x + rng.integers(-30, 30)), int(rng.integers(0, 4))) for c in range(3) for k, x in enumerate(rng.integers(-200, 400, 150))]
    d = spark.createDataFrame(rows, "client long, seq long, cts long, sts long, obj long")
    y = clock.windowed_offset(d, ["client"], "cts", "sts", F.col("obj") <= 1, "seq", window=50, how=how)
    assert "RangeFrame, -49" not in plan(y)
    got = {(r["client"], r["seq"]): r["offset"] for r in y.collect()}
    best = min if how == "min" else max
    for c in range(3):
        held = None
        for _, k, x, _, obj in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            if obj <= 1:
                held = best(q[3] - q[2] for q in rows if q[0] == c and q[4] <= 1 and x - 50 < q[2] <= x)
            assert got[c, k] == held


def test_electrodes_of_one_name_take_the_largest_key(spark):
    cap = spark.createDataFrame([(1, "Fp", 1.0, 2.0), (9, "fp", 3.0, 4.0), (5, "Fp", 5.0, 6.0), (2, "Fp1", 7.0, 8.0), (3, "", 1.0, 1.0)], "k long, name string, lat double, lng double")
    ch = spark.createDataFrame([(0, "FP_x"), (1, "Fp12"), (2, "Oz"), (3, None), (4, "F")], "ch long, name string")
    got = segments.electrode_positions(ch, logs.cap_positions(cap), prefix=True, tie="k")
    rows = {r["ch"]: r for r in got.collect()}
    deg = math.pi / 180
    assert rows[0]["x2"] == pytest.approx(3 * deg * math.cos(4 * deg)) and rows[1]["x2"] == pytest.approx(7 * deg * math.cos(8 * deg))
    assert len(rows) == 5 and [k for k, r in rows.items() if r["iseeg"]] == [0, 1] and rows[4]["x2"] == -1.0


def test_stream_windows_take_the_nearest_second(spark, tmp_path):
    import __spark_entry__ as e

    at = ["2024-01-01 05:59:59.4", "2024-01-01 05:59:59.6", "2024-01-01 07:00:00"]
    d = spark.createDataFrame([(i, t, 1, "view", 1.0) for i, t in enumerate(at)], "event_id long, ts string, user_id long, event_type string, value double")
    d.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["start"]: r["n"] for r in e.queries()["stream_windows"](spark, str(tmp_path)).collect()}
    assert got == {"2023-12-31 18:00:00": 1, "2024-01-01 00:00:00": 3, "2024-01-01 06:00:00": 2}


def test_streams_meet_by_stretches_of_time(spark):
    """Rows of a session meet by time, not all with all; both ends of the overlap count, and so do times before 1970."""
    from pulsegrid.streaming import streams

    ms = [-9, -1, 0, 1, 6, 7, 8, 14, 15, 30]
    rows = [(s, t, i) for s in range(2) for i, t in enumerate(ms)]
    d = spark.createDataFrame(rows, "session long, ts long, samp long").withColumn("time", F.timestamp_millis("ts"))
    stim = d.where("samp % 2 = 0").select("session", "ts", "time", F.col("samp").cast("int").alias("obj"))
    for overlap in (0, 1, 7):
        got = streams.stream_align(stim, d, overlap)
        keys = [line for line in plan(got).splitlines() if "Join" in line][0]
        assert "_to" in keys.split("Inner")[0]
        want = sorted((s, t, o, i) for s, t, o in rows if o % 2 == 0 for s2, u, i in rows if s == s2 and t <= u <= t + overlap)
        assert sorted(map(tuple, got.collect())) == want


def test_lower_bound_step_is_light(monkeypatch):
    """A step asks for no median of numpy and no new window, and tells what the plain definition tells."""
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.exponential(100, 300))
    y = 1.0005 * x + rng.exponential(3, 300) + 400 * (np.arange(300) > 180)
    t = clock.LowerBoundLine(50)
    for a, b in zip(x[:40].tolist(), y[:40].tolist(), strict=True):
        t.step(a, b)
    slope, offset, points, want = t.slope, t.offset, t.points.copy(), []
    for a, b in zip(x[40:100], y[40:100], strict=True):  # no step of the clock here
        points = np.concatenate([points, [[a, b]]])[-50:]
        mid = np.median(points, axis=0)
        px, py = (points - mid).T
        s, o = slope, offset + slope * mid[0] - mid[1]
        for _ in range(3):
            err = py - s * px - o
            off = err - err.mean()
            w = np.where(off > np.abs(off).mean(), 0.0, np.where(err > 0.1, 0.1 / np.maximum(err, 0.1), 1.0))
            mx, my = w @ px / w.sum(), w @ py / w.sum()
            s = w @ ((px - mx) * (py - my)) / (w @ np.square(px - mx))
            o = my - s * mx
        slope, offset = s, o - s * mid[0] + mid[1]
        want.append(slope * a + offset)
    no = lambda *a, **k: pytest.fail("too slow a call for a step")
    monkeypatch.setattr(np, "median", no)
    monkeypatch.setattr(np, "concatenate", no)
    assert np.allclose([t.step(a, b) for a, b in zip(x[40:100].tolist(), y[40:100].tolist(), strict=True)], want, rtol=1e-12)


def test_lower_bound_step_with_nan():
    got = [clock.LowerBoundLine(20, warm=3) for _ in range(2)]
    for i in range(12):
        for t in got:
            t.step(float(i), float(i))
    assert math.isnan(got[0].step(12.0, math.nan)) and got[1].step(12.0, 12.0) == pytest.approx(12.0)


def test_hold_and_code_takes_a_batch_at_once(monkeypatch):
    """No group a sample: one pass an object, with levels, resets and state as a walk over the samples has them."""
    import pandas as pd

    from pulsegrid.streaming import streams

    monkeypatch.setattr(streams, "_stateful", lambda df, keys, out, state, fn, **k: fn)
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *a, **k: pytest.fail("a group a sample"))
    fn = streams.stream_hold_and_code(None, "re", keep=3)

    class State:
        exists, get = False, None

        def update(self, v):
            self.exists, self.get = True, v

    state, rng, held, at = State(), np.random.default_rng(4), {}, 0
    for _ in range(6):
        n = int(rng.integers(3, 30))
        samp, obj, level, reset = at + np.sort(rng.integers(0, n, n)), rng.integers(-1, 3, n), rng.integers(0, 2, n), rng.random(n) < 0.1
        f = pd.DataFrame({"session": 5, "samp": samp, "obj": np.where(obj < 0, np.nan, obj), "level": level, "reset": reset})
        want = []
        for s in np.unique(samp):
            here = samp == s
            if reset[here].any():
                held.clear()
            new = {int(o): int(v) for o, v in zip(obj[here], level[here], strict=True) if o >= 0}
            for o in sorted(held.keys() | new.keys()):
                past = held.setdefault(o, [])
                past.append(new.get(o, past[-1] if past else 0))
                want.append((5, int(s), o, int(len(past) > 1 and past[-2] == 0 and past[-1] > 0)))
        got = [tuple(r) for part in fn((5,), iter([f[: n // 2], f[n // 2 :]]), state) for r in part.to_numpy().tolist()]
        assert got == want and {o: k for o, k in zip(state.get[0], state.get[2], strict=True)} == {o: min(3, len(p)) for o, p in held.items()}
        at += n


def test_a_line_of_a_log_is_rendered_and_parsed_once(spark):
    made = spark.range(3).select(F.lit("s").alias("session"), F.concat(F.lit("rts:3 sts:2  t:DATAPACKET ts:1 v[2x3]:[1,1.5,][2,-2.0,][7.0,"), "id", F.lit(",] <-/a")).alias("value"))
    p = logs.parse_packets(logs.parse_log(made))
    text = p._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("concat(") == 1 and text.count("regexp_extract_all(") == 1
    assert sorted(r.samples for r in p.collect()) == [[[1.0, 1.5], [2.0, -2.0], [7.0, float(k)]] for k in range(3)]


def test_samples_are_numbered_by_day(spark, small):
    from pyspark.sql.window import Window

    from pulsegrid.sources import views

    li = spark.read.parquet(f"{small}/lineitem.parquet")
    w = Window.partitionBy(F.col("l_suppkey") % 16).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    want = sorted((r.session, r.samp, r.q) for r in li.select((F.col("l_suppkey") % 16).alias("session"), (F.row_number().over(w) - 1).alias("samp"), F.col("l_quantity").alias("q")).collect())
    for rows in (1_000_000, 300):
        d = views.samples(spark, small, rows)
        assert dict(d.dtypes) == {"session": "bigint", "samp": "int", "x": "array<double>"}
        assert sorted((r.session, r.samp, r.x[0]) for r in d.collect()) == want
        windows = [line for line in plan(d).splitlines() if "row_number()" in line and "Window" in line]
        assert windows and all("windowspecdefinition(session" in line and "l_shipdate" in line.split("l_orderkey")[0] for line in windows)


def test_learning_curve_sums_training_trials_alone(spark, monkeypatch):
    from pulsegrid.operators import models

    rng = np.random.default_rng(6)
    sig = spark.createDataFrame([(s, t, i, c, float(v)) for s in range(2) for t in range(6) for i in range(20) for c, v in enumerate(rng.normal(size=2))], "session long, trial int, samp int, ch int, v double")
    ev = spark.createDataFrame([(s, t, int(i), o, e, 1.0) for s in range(2) for t in range(6) for o in range(2) for e in ("re", "fe") for i in rng.choice(18, 4, replace=False)], "session long, trial int, samp int, obj long, evt string, v double")
    seen, plain = [], models.summary_stats

    def stats(signal, events, *rest):
        seen.append({(r.session, r.trial) for d in (signal, events) for r in d.select("session", "trial").distinct().collect()})
        return plain(signal, events, *rest)

    monkeypatch.setattr(models, "summary_stats", stats)
    got = models.learning_curve(sig, ev, ["session"], 3, [1, 2], reg=1e-3)
    assert seen == [{(s, t) for s in range(2) for t in range(2)}]
    assert {(r.session, r["size"]) for r in got.collect()} == {(s, n) for s in range(2) for n in (1, 2)}


def test_own_lengths_read_the_scores_once(spark, monkeypatch):
    from pulsegrid.jobs import evaluate

    seen, plain = [], scores.normalize_scores
    monkeypatch.setattr(scores, "normalize_scores", lambda f, *a, **k: seen.append(plan(f)) or plain(f, *a, **k))
    got = evaluate.decoding_curve(fy(spark), ["trial"])[1]
    assert "Scan parquet" in seen[0] and "Join" not in seen[0]
    assert sorted(r.len for r in got.collect()) == [1, 2, 3, 4, 5, 6]


def test_segments_meet_chunks_of_samples(spark, monkeypatch):
    """Repeated times: a segment is joined with chunks, no session is sorted in one task, and of one time before a segment the greatest sample counts."""
    rng = np.random.default_rng(4)
    rows = [(i % 2, int(t), 1000 - i) for i, t in enumerate([*np.repeat([5, 40, 41, 300], 30), *rng.integers(0, 300, 80), -2])] + [(None, 7, 1), (0, None, 2), (0, 5, None)]
    segs = [(i % 3, i, int(b), int(b + d)) for i, (b, d) in enumerate(zip(rng.integers(-9, 320, 60), rng.integers(-3, 90, 60), strict=True))] + [(0, 60, 200, 240), (1, 61, 299, 300), (None, 62, 0, 50)]
    samples = spark.createDataFrame(rows, "session int, ts long, event_id long")
    df = spark.createDataFrame(segs, "session int, seg int, bgn long, end long")
    monkeypatch.setattr(segments, "CHUNK", 4, raising=False)
    got = segments.slice_segments(samples, df, ["session"], width=50)
    want = []
    for s, seg, bgn, end in segs:
        own = sorted(((t, -1 if e is None else e) for k, t, e in rows if k is not None and k == s and t is not None))
        want += [(s, t, e, seg) for t, e in own if bgn <= t < end] + [(s, t, e, seg) for t, e in [x for x in own if x[0] < bgn][-1:] if t < end]
    assert sorted((r.session, r.ts, -1 if r.event_id is None else r.event_id, r.seg) for r in got.collect()) == sorted(want)
    assert "Generate inline" in plan(got)  # chunks are joined, not samples
    assert all("_bucket#" in x.split(")")[0] for x in plan(got).split("windowspecdefinition(")[1:])
