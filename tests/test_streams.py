"""Streams over several batches give the rows of their batch twins, wherever the batches end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import clean, filters
from pulsegrid.operators import blocks, clock, models
from pulsegrid.streaming import streams

KEYS = ["session", "trial"]


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


def written(spark, tmp, df, part, files):
    at = f"file://{tmp}"
    for k in range(files):
        df.where(part == k).coalesce(1).write.mode("append").parquet(at)
    return lambda: streams.stream_table(spark, at, df.schema)


@pytest.fixture(scope="module")
def scored(spark):
    """Trials of unlike length, one shorter than the response."""
    rng = np.random.default_rng(6)
    rows, sig, ev = [], [], []
    for s in range(2):
        for t, n in enumerate((40, 3, 23)):
            for i in range(n):
                x = rng.normal(size=3)
                stim = [(int(o), e, float(v)) for o in range(3) for e in "ab" if (v := rng.integers(-1, 2)) and rng.random() < 0.4]
                rows.append((s, t, i, x.tolist(), [dict(zip(("obj", "evt", "v"), z, strict=True)) for z in stim] or None))
                sig += [(s, t, i, c, float(v)) for c, v in enumerate(x)]
                ev += [(s, t, i, *z) for z in stim]
    w = {e: rng.normal(size=(4, 3)) for e in "ab"}
    df = spark.createDataFrame(rows, "session long, trial long, samp long, x array<double>, stim array<struct<obj:long,evt:string,v:double>>").cache()
    full = spark.createDataFrame([(e, lag, c, float(v)) for e, a in w.items() for (lag, c), v in np.ndenumerate(a)], "evt string, lag int, ch int, w double")
    signal = spark.createDataFrame(sig, "session long, trial long, samp long, ch int, v double")
    events = spark.createDataFrame(ev, "session long, trial long, samp long, obj long, evt string, v double")
    want = {(r.session, r.trial, r.samp, r.obj): r.v for r in models.predict(signal, events, full, KEYS, [], tau=4).collect()}
    return df, w, want


@pytest.mark.parametrize("width", [1, 7])
def test_scores_of_blocks(spark, scored, tmp_path, width):
    df, w, want = scored
    d = df.where("samp < 12") if width == 1 else df
    s = written(spark, tmp_path, d, F.floor(F.col("samp") / width), 12 // width if width == 1 else 6)
    rows = streams.run_to_table(streams.stream_score(s(), w)).collect()
    got = {(r.session, r.trial, r.samp, r.obj): r.v for r in rows}
    assert len(rows) == len(got)  # no doubles
    want = {k: v for k, v in want.items() if width != 1 or k[2] <= 8}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_scores_of_trials(spark, scored, tmp_path):
    df, w, want = scored
    s = written(spark, tmp_path, df, F.floor(F.col("samp") / 8), 5)
    got = {(r.session, r.trial, r.samp, r.obj): r.v for r in streams.run_to_table(streams.stream_score(s(), w, "trial", limit=10)).collect()}
    lengths, sums = {0: 40, 2: 23}, {}
    for t, n in lengths.items():
        for end in {min(8 * k + 7, n - 1) - 3 for k in range(5) if 8 * k < n}:
            for (a, b, i, o), v in want.items():
                if b == t and end - 10 < i <= end:
                    sums[a, b, end, o] = sums.get((a, b, end, o), 0.0) + v
    assert got.keys() == sums.keys() and all(np.isclose(got[k], sums[k]) for k in got)


def test_epochs_wait_for_their_end(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = []
    for s in range(2):
        ts = np.cumsum(rng.integers(5, 16, 400))
        rows += [(s, int(t), None, rng.normal(size=2).tolist()) for t in ts]
        rows += [(s, int(t), "ab"[int(rng.integers(2))], None) for t in rng.choice(ts[-1], 90, replace=False)]
    df = spark.createDataFrame(rows, "session long, ts long, evt string, x array<double>")
    tau, before, after, last = 6, -20, 50, 25
    for centre in (False, True):
        s = written(spark, tmp_path / str(centre), df, F.floor(F.col("ts") / 800), 6)
        t = streams.stream_epochs(s().where("evt is not null"), s().where("evt is null"), tau, (before, after), last, centre)
        got = {(r.session, r.evt): (r.n, np.array(r.v)) for r in streams.run_to_table(t, "update", ["session", "evt"]).collect()}
        for k in range(2):
            data = sorted((t, x) for a, t, e, x in rows if a == k and e is None and t < 4800)
            held = []
            for t, e in sorted((t, e) for a, t, e, _ in rows if a == k and e is not None and t < 4800):
                part = [x for u, x in data if t + before <= u <= t + after][:tau]
                if part and t + after < data[-1][0]:
                    part = np.array(part + part[-1:] * (tau - len(part)))
                    held.append((e, part - part[0] if centre else part))
            held = held[-last:]
            for e in "ab":
                own = [p for f, p in held if f == e]
                assert got[k, e][0] == len(own) and np.allclose(got[k, e][1], np.mean(own, axis=0))


def test_quality_reports(spark, tmp_path):
    rng = np.random.default_rng(13)
    d, n = 6, 300
    x = rng.normal(size=(2, n, d)) * np.arange(d) + np.sin(np.arange(n) / 9)[:, None]
    x[0, :, 3] = 0
    rows = [(s, i, 7 * i + s, x[s, i].tolist()) for s in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "session long, samp long, ts long, x array<double>")
    sos = filters.butter_sections(2, (5.0,), 100.0, "highpass")
    reports = []
    for name, width in (("a", 50), ("b", 61)):
        s = written(spark, tmp_path / name, df, F.floor(F.col("samp") / width), 6)
        reports.append({(r.session, r.ts): (r.raw, r.pre, r.noise) for r in streams.run_to_table(streams.stream_quality(s(), 30.0, 100, blocks.Linear.sections(sos), mean_halflife=60.0)).collect()})
    want = {}
    clean_x = spark.createDataFrame([(s, i, y.tolist()) for s in range(2) for i, y in enumerate(run(sos, x[s]))], "session long, samp long, x array<double>")
    raw = filters.channel_power(df.drop("ts"), ["session"], 30.0, mean_halflife=60.0).select("session", "samp", F.col("x").alias("raw"))
    pre = filters.channel_power(clean_x, ["session"], 30.0, mean_halflife=60.0).select("session", "samp", F.col("x").alias("pre"))
    both = raw.join(pre, ["session", "samp"]).select("session", "samp", "raw", "pre", F.zip_with("raw", "pre", clean.noise_to_signal).alias("noise"))
    all_rows = {(r.session, r.samp): (r.raw, r.pre, r.noise) for r in both.collect()}
    for s in range(2):
        last = None
        for i in range(n):
            ts = 7 * i + s
            if last is None or ts > last + 100:
                last = ts
                want[s, ts] = all_rows[s, i]
    for got in reports:
        assert got.keys() == want.keys()
        assert all(np.allclose(a, b, rtol=1e-7) for k in got for a, b in zip(got[k], want[k], strict=True))


def test_clock_trackers_over_batches(spark, tmp_path):
    rng = np.random.default_rng(14)
    rows = [(c, i, 100.0 * i, 100.05 * i + float(rng.exponential(3)) + 400.0 * (i > 180)) for c in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "client long, seq long, x double, y double")
    s = written(spark, tmp_path, df, F.floor(F.col("seq") / 50), 6)
    for make, batch in ((lambda state: clock.LowerBoundLine(40, state=state), clock.lower_bound_clock(df, ["client"], ["seq"], "x", "y", window=40)), (lambda state: clock.ExpWeightedLine(50.0, state=state), clock.exp_weighted_clock(df, ["client"], ["seq"], "x", "y", 50.0))):
        got = {(r.client, r.seq): r.aligned for r in streams.run_to_table(streams.stream_tracked_clock(s(), make)).collect()}
        want = {(r.client, r.seq): r.aligned for r in batch.collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_refit_on_decayed_statistics(spark, tmp_path):
    rng = np.random.default_rng(15)
    rows = [(0, t, i, c, float(v)) for t in range(5) for i in range(40) for c, v in enumerate(rng.normal(size=3))]
    df = spark.createDataFrame(rows, "session int, trial int, samp long, ch int, v double")
    events = spark.createDataFrame([(0, t, int(i), 0, "a", 1.0) for t in range(5) for i in rng.choice(36, 8, replace=False)], "session int, trial int, samp long, obj int, evt string, v double").cache()
    s = written(spark, tmp_path / "in", df, F.col("trial"), 5)
    at = f"file://{tmp_path}/model"
    update = lambda batch, old: models.updated_stats(batch, events.join(batch.select(*KEYS).distinct(), KEYS, "left_semi"), ["session"], 3, old, 0.5)
    fit = lambda table: models.fit_forward(table, ["session"], 3, 1e-3)
    streams.refit_decayed(s(), update, fit, at).trigger(availableNow=True).start().awaitTermination()
    x = np.zeros((5, 40, 3))
    for _, t, i, c, v in rows:
        x[t, i, c] = v
    want = sum(0.5 ** (4 - t) * x[t].T @ x[t] for t in range(5))
    got = {(r.a, r.b): r.v for r in spark.read.parquet(f"{at}/stats/batch=4").where("stat = 'xx'").collect()}
    assert all(np.isclose(got[i, j], want[i, j]) for i in range(3) for j in range(3))
    before = sorted(map(tuple, spark.read.parquet(f"{at}/model/batch=4").collect()), key=str)
    # the last batch runs again, as after a crash before its commit
    (tmp_path / "model/checkpoint/commits/4").unlink()
    for f in (tmp_path / "model/checkpoint/commits").glob(".4.*"):
        f.unlink()
    streams.refit_decayed(s(), update, fit, at).trigger(availableNow=True).start().awaitTermination()
    after = sorted(map(tuple, spark.read.parquet(f"{at}/model/batch=4").collect()), key=str)
    assert len(after) == len(before) and all(np.isclose(a[-1], b[-1]) for a, b in zip(after, before, strict=True))
