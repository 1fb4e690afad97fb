"""Recursive operators by blocks equal one pass over the whole key, whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import filters
from pulsegrid.operators import blocks, clock

RNG = np.random.default_rng(21)
D, LENGTHS = 6, [90, 41, 7, 130]


@pytest.fixture(scope="module")
def rec(spark):
    """Two sessions with trials of unlike length; a channel of session 1 is dead at first."""
    x = {(s, t): RNG.normal(size=(n, D)) * np.arange(1, D + 1) for s in range(2) for t, n in enumerate(LENGTHS)}
    x[1, 0][:, 2] = 0
    rows = [(s, t, i, v.tolist(), f"{s}{t}{i}") for (s, t), a in x.items() for i, v in enumerate(a)]
    return x, spark.createDataFrame(rows, "session int, trial int, samp int, x array<double>, tag string").repartition(5).cache()


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


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.session, r.trial), []).append((r.samp, r.x, r.tag))
    for (s, t), v in out.items():
        assert all(tag == f"{s}{t}{i}" for i, _, tag in v)  # other columns stay with their row
    return {k: np.array([x for _, x, _ in sorted(v)]) for k, v in out.items()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-8, atol=1e-10) for k in a)


def test_linear_system_of_sections():
    sos = np.concatenate([filters.butter_sections(4, (0, 2), 100.0), filters.butter_sections(3, (8, 20), 100.0, "bandpass")])
    lin, x = blocks.Linear.sections(sos), RNG.normal(size=(333, 3))
    warm = lin.steady(x[0])
    assert np.allclose(lin.run(np.tile(x[0], (50, 1)), warm)[1], warm)
    y, s = lin.run(x, warm)
    assert np.allclose(y, run(sos, x))
    nothing = np.zeros_like(warm)
    assert np.allclose(s, lin.after(333, warm) + lin.run(x, nothing)[1])
    half, mid = lin.run(x[:100], warm)
    assert np.allclose(np.concatenate([half, lin.run(x[100:], mid)[0]]), y)


def test_blocks_hold_at_most_size_samples(rec):
    b = blocks.to_blocks(rec[1], ["session"], 50, "trial").collect()
    assert sorted((r.session, r.block, len(r.rows)) for r in b) == [(s, k, min(50, sum(LENGTHS) - 50 * k)) for s in range(2) for k in range(6)]
    assert all([(q.trial, q.samp) for q in r.rows] == sorted((q.trial, q.samp) for q in r.rows) for r in b)


def test_filters_by_blocks(rec, monkeypatch):
    x, df = rec
    keys = ["session", "trial"]
    bands = [(0, 2), (30, -1)]
    sos = np.concatenate([filters.butter_sections(4, b, 100.0) for b in bands])
    monkeypatch.setattr(blocks, "FAN", 3)  # the scan takes several levels
    got = back(filters.iir_filter(df, keys, 100.0, bands, size=9))
    assert same(got, {k: run(sos, v) for k, v in x.items()})
    mid = filters.butter_sections(2, (8, 20), 100.0, "bandpass")
    bank = back(filters.iir_filterbank(df, keys, 100.0, [(8, 20), (8, 20)], order=2, size=33))
    assert same(bank, {k: np.tile(run(mid, v), 2) for k, v in x.items()})


def test_powers_by_blocks(rec, monkeypatch):
    x, df = rec
    monkeypatch.setattr(blocks, "FAN", 4)
    want = {}
    for s in range(2):
        whole = np.concatenate([x[s, t] for t in range(len(LENGTHS))])
        p, out = np.where(whole[0] == 0, 1.0, whole[0] ** 2), []
        for i, v in enumerate(whole):
            p = p if i == 0 else 0.95 * p + 0.05 * v * v
            out.append(v / np.sqrt((p + 0.1 * np.median(p)) / 2))
        for t, part in enumerate(np.split(np.array(out), np.cumsum(LENGTHS)[:-1])):
            want[s, t] = part
    assert same(back(filters.standardize_power(df, ["session"], alpha=0.05, size=17)), want)
    few = df.withColumn("x", F.slice("x", 1, 3))
    for d in (df, few):
        assert same(back(filters.channel_power(d, ["session", "trial"], 20.0, size=11)), back(filters.channel_power(d, ["session", "trial"], 20.0)))
    a, b = (back(filters.decorrelate_ar(df, ["session"], taps=5, eta=0.01, size=n)) for n in (23, 1000))
    assert same(a, b) and not same(a, x)
    assert filters.decorrelate_ar(df.limit(0), ["session"]).count() == 0


def points(spark, n=400, step_at=250):
    """A clock that drifts, with delays that are never negative, and a step of half a second."""
    rng = np.random.default_rng(2)
    rows = [(c, i, 100.0 * i, 100.02 * i + 50 + float(rng.exponential(3)) + (500.0 if c == "b" and i >= step_at else 0.0)) for c in "ab" for i in range(n)]
    return rows, spark.createDataFrame(rows, "client string, i long, x double, y double").repartition(3)


def bound_of(xy, window=50, c=0.1, thresh=1.0, last=10, jump=2.0, warm=10):
    """The tracker from its definition, with a solver of least squares."""
    held, a, b, out = [], 1.0, None, []
    for x, y in xy:
        held = (held + [(x, y)])[-window:]
        p = np.array(held)
        if b is None:
            b = y - x
            out.append(y)
            continue
        if len(p) < warm:
            if len(p) > 2:
                a = np.median(np.diff(p[:, 1]) / np.diff(p[:, 0]))
            b = y - a * x
        else:
            mx, my = np.median(p[:, 0]), np.median(p[:, 1])
            u, v = p[:, 0] - mx, p[:, 1] - my
            k, o = a, b + a * mx - my
            for _ in range(3):
                e = v - k * u - o
                w = np.ones(len(e))
                w[e > c] = c / e[e > c]
                w[e - e.mean() > thresh * np.abs(e - e.mean()).mean()] = 0
                r = np.sqrt(w)
                k, o = np.linalg.lstsq(np.stack([u * r, r], axis=1), v * r, rcond=None)[0]
            a, b = k, o - k * mx + my
            if len(e) > 2 * last and abs(np.median(e[-last:]) - np.median(e[:-last])) > jump * np.std(e[:-last]):
                held = []
        out.append(a * x + b)
    return out


def test_lower_bound_clock(spark):
    rows, df = points(spark)
    got = {(r.client, r.i): r.aligned for r in clock.lower_bound_clock(df, ["client"], ["i"], "x", "y", window=50, size=64).collect()}
    for c in "ab":
        want = bound_of([(x, y) for k, _, x, y in rows if k == c])
        assert np.allclose([got[c, i] for i in range(400)], want, atol=1e-3)
    assert got["a", 0] == rows[0][3]  # the first point is its own answer
    for c, step in (("a", 0.0), ("b", 500.0)):
        assert abs(got[c, 399] - (100.02 * 399 + 50 + step)) < 5
        assert abs(got[c, 240] - (100.02 * 240 + 50)) < 5
    assert abs(got["b", 290] - (100.02 * 290 + 550)) < 10  # 40 points after the step
    both = clock.lower_bound_clock(df, ["client"], ["i"], "x", "y", window=50, soft=(0.1, 0.1), hard=(None, 3.0)).where("client = 'a' and i = 399").first().aligned
    assert abs(both - (100.02 * 399 + 50 + 3)) < 5


def test_exp_weighted_clock_by_blocks(spark):
    _, df = points(spark)
    a, b = ({(r.client, r.i): r.aligned for r in clock.exp_weighted_clock(df, ["client"], ["i"], "x", "y", size=n).collect()} for n in (70, 10_000))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    assert abs(a["a", 399] - (100.02 * 399 + 53)) < 5
