"""Values of filters, models, readers and streams against plain numpy."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.operators import models, scores, stats
from pulsegrid.sources import logs
from pulsegrid.streaming import streams

RNG = np.random.default_rng(7)
N, D, TRIALS = 120, 6, 3
X = RNG.normal(size=(2, TRIALS, N, D)) @ np.diag(np.arange(1, D + 1))  # session, trial, sample, channel


@pytest.fixture(scope="module")
def rec(spark):
    rows = [(s, t, i, X[s, t, i].tolist()) for s in range(2) for t in range(TRIALS) for i in range(N)]
    return spark.createDataFrame(rows, "session int, trial int, samp long, x array<double>").repartition(4).cache()


def back(df):
    """(session, trial) -> samples by channels."""
    out = {}
    for r in df.collect():
        out.setdefault((r.session, r.trial), []).append((r.samp, r.x))
    return {k: np.array([x for _, x in sorted(v)]) for k, v in out.items()}


def run(sos, x):
    """Second-order sections by the difference equation, each from its steady state."""
    for b0, b1, b2, _, a1, a2 in sos:
        gain, y = (b0 + b1 + b2) / (1 + a1 + a2), np.zeros_like(x)
        for t in range(len(x)):
            x1, x2 = (x[t - k] if t >= k else x[0] for k in (1, 2))
            y1, y2 = (y[t - k] if t >= k else gain * x[0] for k in (1, 2))
            y[t] = b0 * x[t] + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x = y
    return x


def test_filters(rec):
    keys = ["session", "trial"]
    low, mid = filters.butter_sections(2, (10.0,), 100.0, "lowpass"), filters.butter_sections(2, (8, 20), 100.0, "bandpass")
    got = back(filters.iir_filter(rec, keys, 100.0, [(10, -1)], order=2))
    bank = back(filters.iir_filterbank(rec, keys, 100.0, [(8, 20), (8, 20)], order=2))
    down = back(filters.filter_downsample(rec, keys, 100.0, [(10, -1)], 40.0, order=2))
    fft = back(filters.fft_filterbank(rec, keys, 100.0, [(0, 10), (10, 51)]))
    for (s, t), y in got.items():
        assert np.allclose(y, run(low, X[s, t]))
        assert np.allclose(bank[s, t], np.tile(run(mid, X[s, t]), 2))
        assert np.allclose(down[s, t][:3], [y[0], (y[2] + y[3]) / 2, y[5]])  # 100 to 40: every 2.5th
        assert np.allclose(fft[s, t][:, :D] + fft[s, t][:, D:], X[s, t])


def test_powers_flow_from_trial_to_trial(rec):
    std, ar = back(filters.standardize_power(rec, ["session"], alpha=0.1)), back(filters.decorrelate_ar(rec, ["session"], taps=3, eta=0.01, reg=0.5))
    power = back(filters.channel_power(rec, ["session", "trial"], 20.0))
    for s in range(2):
        p, w = X[s, 0, 0] ** 2, np.zeros((3, D))
        w[2] = 1
        for t in range(TRIALS):
            h, a, n, q = np.ones(D), 0.5 ** (1 / 20), 0.0, np.zeros(D)
            m = np.zeros(D)
            for i, v in enumerate(X[s, t]):
                p = 0.9 * p + 0.1 * v * v
                assert np.allclose(std[s, t][i], v / np.sqrt((p + 0.1 * np.median(p)) / 2))
                if i < 3:
                    assert np.allclose(ar[s, t][i], v)
                else:
                    past = X[s, t, i - 3 : i]
                    guess = (w * past).sum(0)
                    assert np.allclose(ar[s, t][i], v - 0.5 * guess)
                    h = h * 0.99 + 0.01 * v * v
                    w = w + 0.01 * (v - guess) * past / h
                u = v - (v[q > 1e-3 * q.max()] if q.any() else v).mean()
                n, m = a * n + 1, a * m + u
                q = a * q + (u - m / n) ** 2
                assert np.allclose(power[s, t][i], q / n)


def test_whitening_envelope_spectrum(rec):
    white = back(filters.spatial_whiten(rec, ["session"]))
    env = back(filters.envelope(rec, ["session", "trial"], 100.0, None, ["session"], [(8, 20)], env_stop=(10, -1)))
    flat = back(filters.spectral_whiten(rec, ["session"], reg=0.01))
    mid, low = filters.butter_sections(4, (8, 20), 100.0, "bandpass"), filters.butter_sections(4, (10, -1), 100.0)
    for s in range(2):
        w = np.concatenate([white[s, t] for t in range(TRIALS)])
        assert np.allclose(w.T @ w / len(w), np.eye(D), atol=1e-8)
        amp = np.mean([np.abs(np.fft.fft(X[s, t], axis=0)) for t in range(TRIALS)], axis=0)
        for t in range(TRIALS):
            assert np.allclose(env[s, t], run(low, np.log(np.maximum(np.abs(run(mid, white[s, t])), 1e-6))))
            assert np.allclose(flat[s, t], np.real(np.fft.ifft(np.fft.fft(X[s, t], axis=0) / (amp + 0.01 * amp.max()), axis=0)))
    got = filters.average_spectrum(rec, ["session"], "trial", 100.0, 40).where("session = 0 and ch = 1").orderBy("freq").collect()
    win, per = np.hanning(41)[:40], []
    for t in range(TRIALS):
        parts = [np.abs(np.fft.rfft((y := X[0, t, k : k + 40, 1]) * 0 + (y - y.mean()) * win)) ** 2 for k in range(0, 81, 20)]
        p = np.mean(parts, axis=0) / (100 * (win**2).sum())
        p[1:20] *= 2
        per.append(p)
    assert np.allclose([r.p for r in got], np.median(per, axis=0))


@pytest.fixture(scope="module")
def coded(spark):
    """Signals that answer events: events(obj 0..2, evt a, b), long signal."""
    rng = np.random.default_rng(3)
    y = (rng.random((2, TRIALS, N, 3, 2)) < 0.15).astype(float)  # session, trial, sample, object, event
    r, a = rng.normal(size=(2, 4)), rng.normal(size=D)
    x = 0.2 * rng.normal(size=(2, TRIALS, N, D))
    for e in range(2):
        for k in range(4):
            x[:, :, k:] += r[e, k] * y[:, :, : N - k, 0, e, None] * a
    sig = spark.createDataFrame([(s, t, i, c, float(x[s, t, i, c])) for s in range(2) for t in range(TRIALS) for i in range(N) for c in range(D)], "session int, trial int, samp long, ch int, v double").cache()
    ev = spark.createDataFrame([(s, t, i, o, "ab"[e], float(y[s, t, i, o, e])) for s, t, i, o, e in np.argwhere(y > 0).tolist()], "session int, trial int, samp long, obj int, evt string, v double").cache()
    return x, y, sig, ev


def lagged(y, tau=4):
    """trial, sample, event * lag"""
    out = np.zeros((*y.shape[:2], 2 * tau))
    for e in range(2):
        for k in range(tau):
            out[:, k:, e * tau + k] = y[:, : N - k, 0, e]
    return out


def test_models_meet_least_squares(coded):
    x, y, sig, ev = coded
    keys = ["session", "trial"]
    table = models.summary_stats(sig, ev, keys, ["session"], 4).cache()
    forward = {(r.session, r.k, r.evt, r.idx): r.v for r in models.fit_forward(table, ["session"], 4).collect()}
    full = models.factored_to_full(models.fit_cca(table, ["session"], 4, rank=1), ["session"]).cache()
    cca = {(r.session, r.evt, r.lag, r.ch): r.w for r in full.collect()}
    pred = {(r.session, r.trial, r.samp, r.obj): r.v for r in models.predict(sig, ev, full, keys, ["session"]).collect()}
    for s in range(2):
        a, b = lagged(y[s]).reshape(-1, 8), x[s].reshape(-1, D)
        want = np.linalg.lstsq(a, b, rcond=None)[0]
        got = np.array([[forward[s, c, "ab"[i // 4], i % 4] for c in range(D)] for i in range(8)])
        assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.98  # sums leave out the edges of trials
        w = np.array([[[cca[s, e, k, c] for c in range(D)] for k in range(4)] for e in "ab"])
        for t in range(TRIALS):
            fe = np.array([[(w[e] * x[s, t, i : i + 4]).sum() for e in range(2)] for i in range(N - 3)])
            for i in range(0, N - 3, 7):
                for o in range(3):
                    if y[s, t, i, o].any():
                        assert np.isclose(pred[s, t, i, o], (fe[i] * y[s, t, i, o]).sum())
        m = np.concatenate([lagged(y[s])[t] for t in range(TRIALS)])
        u, sv, vt = np.linalg.svd(np.linalg.lstsq(m, b, rcond=None)[0])
        assert abs(np.corrcoef(w.reshape(8, D).ravel(), np.outer(m.T @ b @ vt[0], vt[0]).ravel())[0, 1]) > 0.2


def test_patterns_and_backward(coded):
    x, y, sig, ev = coded
    keys = ["session", "trial"]
    table = models.summary_stats(sig, ev, keys, ["session"], 4).cache()
    model = models.fit_cca(table, ["session"], 4, rank=1).cache()
    w = {(r.session, r.idx): r.v for r in model.where("kind = 'w'").collect()}
    pat = {(r.session, r.ch): r.v for r in models.spatial_pattern(model, table, ["session"]).collect()}
    target = ev.where("obj = 0 and evt = 'a'").sparkSession.createDataFrame([(s, t, i, float(y[s, t, i, 0, 0])) for s in range(2) for t in range(TRIALS) for i in range(N)], "session int, trial int, samp long, v double")
    bwd = {(r.session, r.lag, r.ch): r.w for r in models.fit_backward(sig, target, keys, ["session"], 3).collect()}
    for s in range(2):
        c = sum(x[s, t].T @ x[s, t] for t in range(TRIALS))
        assert np.allclose([pat[s, i] for i in range(D)], c @ [w[s, i] for i in range(D)])
        a = np.concatenate([np.concatenate([x[s, t, k : N - 2 + k] for k in range(3)], axis=1) for t in range(TRIALS)])
        b = np.concatenate([y[s, t, : N - 2, 0, 0] for t in range(TRIALS)])
        want = np.linalg.lstsq(a, b, rcond=None)[0]
        assert np.allclose([[bwd[s, k, i] for i in range(D)] for k in range(3)], want.reshape(3, D))


def test_held_out_trials_and_searches(coded):
    _, _, sig, ev = coded
    out = sig.where("trial = 2").select("session", "trial").distinct()
    got = models.holdout_eval(sig, ev, ["session"], 4, out, folds=2, rank=1).cache()
    rows = got.collect()
    assert {(r.trial, r.test) for r in rows} == {(0, False), (1, False), (2, True)}
    key = lambda rows: {(r.session, r.trial, r.samp, r.obj): round(r.v, 9) for r in rows}
    train = [d.where("trial < 2") for d in (sig, ev)]
    assert key(r for r in rows if not r.test) == key(models.cross_validate(*train, ["session"], 4, 2, [1])[0].collect())
    table = models.summary_stats(*train, ["session", "trial"], ["session"], 4)
    full = models.factored_to_full(models.fit_cca(table, ["session"], 4, 1), ["session"])
    assert key(r for r in rows if r.test) == key(models.predict(sig.where("trial = 2"), ev.where("trial = 2"), full, ["session", "trial"], ["session"]).collect())
    score = {r.session: r.score for r in scores.audc_score(got.where("test"), ["session", "trial"], ["session"]).collect()}
    assert all(v > 0.8 for v in score.values())  # the true output leads on trials that the model never saw


def test_erp_components_rebuild_the_mean(coded):
    _, _, sig, ev = coded
    mean = stats.erp(sig, ev.where("obj = 0"), ["session", "trial"], ["session"], 4).cache()
    m = {(r.session, r.evt, r.lag, r.ch): r.v for r in mean.collect()}
    got = {}
    for r in stats.erp_components(mean, ["session"], D).collect():
        got[r.session, r.evt, r.k, r.kind, r.idx] = r.v
    for (s, e, lag, ch), v in m.items():
        ks = {k for a, b, k, kind, i in got if (a, b, kind, i) == (s, e, "time", lag)}
        assert np.isclose(sum(got[s, e, k, "time", lag] * got[s, e, k, "space", ch] for k in ks), v)


def test_classifier_learns(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 3))
    rows = [(x.tolist(), float(x @ [1, -2, 0.5] > 0)) for x in a]
    d = spark.createDataFrame(rows, "win array<double>, y double")
    for kind in ("logistic",):
        m = models.fit_classifier(d, "y", kind).transform(d.withColumn("features", array_to_vector("win")))
        assert m.where("prediction = y").count() > 380
    for kind in ("ridge", "huber"):
        m = models.fit_classifier(d, "y", kind).transform(d.withColumn("features", array_to_vector("win")))
        assert m.where("(prediction > 0.5) = (y = 1)").count() > 360


def test_recorded_buffers(spark, tmp_path):
    for name, kind, t in (("s1", 9, "<f4"), ("s2", 6, "<i2")):
        (tmp_path / name).mkdir()
        x = np.arange(12).reshape(4, 3)
        (tmp_path / name / "header").write_bytes(struct.pack("<IIIfII", 3, 4, 2, 250.0, kind, 0) + b"labels")
        (tmp_path / name / "samples").write_bytes(x.astype(t).tobytes() + b"\1")
        one = struct.pack("<IIIIiiiI", 0, 4, 7, 2, 10, -1, 5, 12) + b"trig" + struct.pack("<ii", 3, -4)
        (tmp_path / name / "events").write_bytes(one + struct.pack("<IIIIiiiI", 0, 9, 0, 9, 1, 0, 0, 2) + b"no" + struct.pack("<IIIIiiiI", 0, 1, 0, 2, 20, 0, 0, 3) + b"abc")
    at = f"file://{tmp_path}"
    assert sorted(map(tuple, logs.read_buffer_header(spark, at).collect())) == [("s1", 3, 4, 2, 250.0, 9), ("s2", 3, 4, 2, 250.0, 6)]
    got = sorted((r.session, r.samp, r.x) for r in logs.read_buffer_dir(spark, at).collect())
    assert got == [(s, i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2]) for s in ("s1", "s2") for i in range(4)]
    x = np.random.default_rng(3).normal(size=(25_000, 3))  # one large file, read by many tasks
    (tmp_path / "s1" / "samples").write_bytes(x.astype("<f4").tobytes() + b"\1\2")
    d = logs.read_buffer_dir(spark, at, slice_bytes=30_000).where("session = 's1'")
    assert d.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    rows = sorted((r.samp, r.x) for r in d.collect())
    assert [i for i, _ in rows] == list(range(25_000)) and np.allclose([v for _, v in rows], x.astype("<f4"))
    assert sorted(map(tuple, logs.read_buffer_events(spark, at).where("session = 's1'").collect())) == [("s1", 10, "trig", "3,-4", -1, 5), ("s1", 20, "a", "bc", 0, 0)]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A recording in six files, in order of time."""
    at = str(tmp_path_factory.mktemp("parts"))
    rng = np.random.default_rng(9)
    rows = [(i % 3, i, int(rng.integers(2)), float(rng.normal()), i in (200, 401)) for i in range(600)]
    for k in range(6):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], "session long, samp long, level int, v double, reset boolean").coalesce(1).write.mode("append").parquet(at)
    return f"file://{at}", rows


def stream_of(spark, at):
    return streams.stream_table(spark, at, spark.read.parquet(at).schema)


def test_streams_over_several_batches(spark, parts):
    """State carries over: each stream gives the rows of one pass over the whole table."""
    at, rows = parts
    s = stream_of(spark, at)
    got = {(r.session, r.samp): r.v for r in streams.run_to_table(streams.stream_code(s.select("session", F.lit(0).cast("long").alias("obj"), "samp", "level"))).collect()}
    for k in range(3):
        own = [(i, v) for a, i, v, _, _ in rows if a == k]
        assert [got[k, i] for i, _ in own] == [int(j > 0 and own[j - 1][1] == 0 and v == 1) for j, (_, v) in enumerate(own)]
    sos = filters.butter_sections(2, (10.0,), 100.0, "lowpass")
    flt = {(r.session, r.samp): r.x[0] for r in streams.run_to_table(streams.stream_filter(stream_of(spark, at).select("session", "samp", F.array("v").alias("x")), sos)).collect()}
    for k in range(3):
        own = [(i, v) for a, i, _, v, _ in rows if a == k]
        assert np.allclose([flt[k, i] for i, _ in own], run(sos, np.array([[v] for _, v in own]))[:, 0])
    erp = {(r.evt, r.lag): (r.v, r.n) for r in streams.run_to_table(streams.stream_erp(stream_of(spark, at).select(F.concat(F.lit("e"), F.col("session")).alias("evt"), F.lit(0).cast("long").alias("lag"), F.col("samp").alias("epoch"), "v"), last=50), "update", ["evt", "lag"]).collect()}
    assert len(erp) == 3
    for k in range(3):
        own = [v for a, _, _, v, _ in rows if a == k][-50:]
        assert np.isclose(erp[f"e{k}", 0][0], np.mean(own)) and erp[f"e{k}", 0][1] == 50
    clock = {(r.client, r.seq): r.aligned for r in streams.run_to_table(streams.clock_align_stream(stream_of(spark, at).select(F.col("session").alias("client"), F.col("samp").alias("seq"), F.col("samp").alias("cts"), (F.col("samp") + 10 + F.col("level") * 5 + F.col("samp") % 4).alias("sts"), (F.col("level") == 1).alias("sync")), 40)).collect()}
    for k in range(3):
        sync: list[tuple[int, int]] = []
        for a, i, v, _, _ in rows:
            if a == k:
                if v:
                    sync.append((i, 15 + i % 4))
                near = [d for c, d in sync if c > i - 40] or [d for _, d in sync[-1:]] or [0]
                assert clock[k, i] == i + min(near)


def test_hold_and_code_forgets_at_a_new_target(spark, parts):
    at, rows = parts
    s = stream_of(spark, at).select("session", "samp", F.when(F.col("samp") % 4 != 0, F.col("samp") % 2).alias("obj"), "level", "reset")
    got = {(r.session, r.samp, r.obj): r.v for r in streams.run_to_table(streams.stream_hold_and_code(s)).collect()}
    want, held = {}, {}
    for k, i, level, _, reset in rows:
        h = held.setdefault(k, {})
        if reset:
            h.clear()
        obj = i % 2 if i % 4 else None
        for o in sorted(h.keys() | ({obj} if obj is not None else set())):
            past = h.setdefault(o, [])
            past.append(level if o == obj else past[-1] if past else 0)
            want[k, i, o] = int(len(past) > 1 and past[-2] == 0 and past[-1] > 0)
    assert got == want


def test_an_empty_stream_is_an_empty_table(spark, tmp_path):
    at = f"file://{tmp_path}/none"
    spark.createDataFrame([], "session long, samp long, v double").write.parquet(at)
    s = stream_of(spark, at)
    assert streams.run_to_table(s).count() == 0
    assert streams.run_to_table(streams.stream_sums(s, ["session"]), "complete").count() == 0
    assert streams.run_to_table(streams.last_prediction(s.select("session", F.col("samp").alias("ts"), F.col("samp").alias("yest"), F.col("v").alias("perr")), ["session"]), "update", ["session"]).count() == 0
