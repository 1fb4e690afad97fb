"""Classifiers by group against a single machine; grids and curves from one table of statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import models, scores

KEYS = ["session", "trial"]
P = 4


def newton(x, y, kind, reg=1.0, delta=1.35):
    """The minimum of the summed loss, by many small steps on one machine."""
    x = np.c_[x, np.ones(len(x))]
    keep = reg * (np.arange(x.shape[1]) < x.shape[1] - 1)

    def loss(w):
        s = x @ w
        part = {"ridge": (s - y) ** 2 / 2, "logistic": np.logaddexp(0, s) - y * s, "hinge": np.maximum(1 - (2 * y - 1) * s, 0) ** 2 / 2, "huber": np.where(np.abs(s - y) <= delta, (s - y) ** 2 / 2, delta * np.abs(s - y) - delta**2 / 2)}[kind]
        return part.sum() + (keep * w * w).sum() / 2

    def slope(w):
        s = x @ w
        t = 2 * y - 1
        g = {"ridge": s - y, "logistic": 1 / (1 + np.exp(-s)) - y, "hinge": -t * np.maximum(1 - t * s, 0), "huber": np.clip(s - y, -delta, delta)}[kind]
        return x.T @ g + keep * w

    w, step = np.zeros(x.shape[1]), 1.0 / np.linalg.eigvalsh(x.T @ x + np.diag(keep)).max()
    v, k = w.copy(), 1.0
    for _ in range(20_000):
        new = v - step * slope(v)
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, w, k = new + (k - 1) / nk * (new - w), new, nk
        if np.abs(slope(w)).max() < 1e-9:
            break
    assert np.abs(slope(w)).max() < 1e-6 and loss(w) <= loss(np.zeros_like(w))
    return w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    out = {}
    for g, n in (("a", 300), ("b", 90)):
        x = rng.normal(size=(n, P))
        s = x @ rng.normal(size=P) + 0.3 + rng.normal(size=n)
        out[g] = x, s, np.digitize(s, [-0.7, 0.9])  # three classes
    rows = [(g, x.tolist(), float(s), int(c), "x") for g, (xs, ss, cs) in out.items() for x, s, c in zip(xs, ss, cs, strict=True)]
    rows += [("a", [5.0] * P, None, None, "x")] * 20
    return out, spark.createDataFrame(rows, "session string, win array<double>, y double, c int, cls string").repartition(4).cache()


@pytest.mark.parametrize("kind", ["ridge", "huber"])
def test_regression_by_group(data, kind):
    out, df = data
    got = {r.session: r.w for r in models.fit_by_group(df, ["session"], "y", kind).collect()}
    for g, (x, s, _) in out.items():
        assert np.allclose(got[g], newton(x, s, kind), atol=1e-4)


@pytest.mark.parametrize("kind", ["logistic", "hinge"])
def test_classes_by_group(data, kind):
    out, df = data
    m = models.fit_by_group(df, ["session"], "c", kind).cache()
    got = {(r.session, r.cls): r.w for r in m.collect()}
    for g, (x, _, c) in out.items():
        want = np.array([newton(x, (c == k).astype(float), kind) for k in range(3)])
        assert np.allclose([got[g, str(k)] for k in range(3)], want, atol=1e-3)
    hits = models.classify(df.drop("cls").where("c is not null"), m, ["session"], kind).select(F.avg((F.col("prediction") == F.col("c").cast("string")).cast("int"))).first()[0]
    assert hits > 0.55
    more = models.fit_by_group(df, ["session"], "c", kind, unlabelled=True).cache()
    assert {r.cls for r in more.where("session = 'a'").collect()} == {"0", "1", "2", None} and more.where("session = 'b'").count() == 3
    blank = models.classify(df.drop("cls").where("c is null"), more, ["session"], kind)
    assert blank.where("prediction is null").count() == 20


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(5)
    n, d = 60, 4
    y = (rng.random((2, 4, n, 2)) < 0.2).astype(float)
    x = rng.normal(size=(2, 4, n, d))
    for k in range(3):
        x[:, :, k:] += (2 - k) * y[:, :, : n - k, 0, None]
    sig = spark.createDataFrame([(s, t, i, c, float(x[s, t, i, c])) for s in range(2) for t in range(4) for i in range(n - 7 * t) for c in range(d)], "session int, trial int, samp long, ch int, v double").cache()
    ev = spark.createDataFrame([(s, t, i, o, "a", 1.0) for s, t, i, o in np.argwhere(y > 0).tolist()], "session int, trial int, samp long, obj int, evt string, v double").cache()
    return sig, ev


def cells(df):
    return {(r.session, r.stat, r.e1, r.e2, r.a, r.b): r.v for r in df.collect()}


def test_every_length_is_a_slice_of_the_longest(coded):
    sig, ev = coded
    nested = models.nested_stats(sig, ev, KEYS, ["session"], 6).cache()
    for tau in (1, 3, 6):
        got, want = cells(models.sliced_stats(nested, ["session"], tau)), cells(models.summary_stats(sig, ev, KEYS, ["session"], tau))
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got), tau


def test_grid_equals_separate_fits(coded):
    sig, ev = coded
    got = {(r.tau, r["rank"]): (r["mean"], r.sd) for r in models.grid_search(sig, ev, ["session"], [2, 4], [1, 2], 2, reg=1e-3).collect()}
    for tau in (2, 4):
        alone = models.cross_validate(sig, ev, ["session"], tau, 2, [1, 2], 1e-3)[1].collect()
        for rank in (1, 2):
            s = [r.score for r in alone if r["rank"] == rank]
            assert np.allclose(got[tau, rank], (np.mean(s), np.std(s)))


def test_learning_curve_equals_separate_fits(coded):
    sig, ev = coded
    got = {(r.session, r["size"]): r.score for r in models.learning_curve(sig, ev, ["session"], 3, [1, 3], reg=1e-3).collect()}
    for k in (1, 3):
        full = models.factored_to_full(models.fit_cca(models.summary_stats(sig.where(f"trial < {k}"), ev.where(f"trial < {k}"), KEYS, ["session"], 3), ["session"], 3, 1, 1e-3, 1e-3), ["session"])
        fy = models.predict(sig.where(f"trial >= {k}"), ev.where(f"trial >= {k}"), full, KEYS, ["session"])
        for r in scores.audc_score(fy, KEYS, ["session"]).collect():
            assert np.isclose(got[r.session, k], r.score)
