"""Models of sessions whose channel sets are unlike: a channel is told by its number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.jobs import more_queries
from pulsegrid.operators import models, stats

N, D = 80, 6
KEYS = ["session", "trial"]


@pytest.fixture(scope="module")
def ragged(spark):
    """Session 0 has all channels, session 1 lacks the first, a middle and the last one."""
    rng = np.random.default_rng(11)
    y = (rng.random((2, 3, N, 2)) < 0.2).astype(float)
    x = rng.normal(size=(2, 3, N, D)) + 3 * y[..., 0, None] * rng.normal(size=D)
    rows = [(s, t, i, c, float(x[s, t, i, c])) for s in range(2) for t in range(3) for i in range(N) for c in range(D) if s == 0 or c not in (0, 3, 5)]
    sig = spark.createDataFrame(rows, "session int, trial int, samp long, ch int, v double").cache()
    ev = spark.createDataFrame([(s, t, i, o, "a", 1.0) for s, t, i, o in np.argwhere(y > 0).tolist()], "session int, trial int, samp long, obj int, evt string, v double").cache()
    return x, sig, ev


def renumbered(sig):
    """Session 1 alone, its three channels as 0, 1, 2."""
    return sig.where("session = 1").withColumn("ch", F.when(F.col("ch") == 1, 0).when(F.col("ch") == 2, 1).otherwise(2))


def test_fit_by_channel_number(spark, ragged):
    x, sig, ev = ragged
    both = models.summary_stats(sig, ev, KEYS, ["session"], 3).cache()
    xx = {(r.a, r.b): r.v for r in both.where("stat = 'xx' and session = 1").collect()}
    assert sorted({a for a, _ in xx}) == [1, 2, 4]
    flat = x[1].reshape(-1, D)
    assert all(np.isclose(v, flat[:, a] @ flat[:, b]) for (a, b), v in xx.items())
    alone = models.summary_stats(renumbered(sig), ev.where("session = 1"), KEYS, ["session"], 3)
    at = {0: 1, 1: 2, 2: 4}
    for fit in (models.fit_cca, models.fit_forward):
        want = {(at[r.k] if fit is models.fit_forward else r.k, r.kind, r.evt, at[r.idx] if r.kind == "w" else r.idx): r.v for r in fit(alone, ["session"], 3).collect()}
        got = {(r.k, r.kind, r.evt, r.idx): r.v for r in fit(both, ["session"], 3).where("session = 1").collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)
    target = sig.where("ch = 1").select(*KEYS, "samp", (2 * F.col("v")).alias("v"))
    w = {(r.session, r.lag, r.ch): r.w for r in models.fit_backward(sig, target, KEYS, ["session"], 2).collect()}
    assert len(w) == 2 * (D + 3) and all(np.isclose(v, 2.0 * (k[1:] == (0, 1)), atol=1e-6) for k, v in w.items())


def test_a_sample_may_lack_a_channel(ragged):
    x, sig, _ = ragged
    some = sig.where("not (session = 0 and ch = 2 and samp % 2 = 1)")
    a, chs = stats.aligned_arrays(some, KEYS, ["session"])
    assert {r.session: r.chs for r in chs.collect()} == {0: [0, 1, 2, 3, 4, 5], 1: [1, 2, 4]}
    got = a.where("session = 0 and trial = 1 and samp = 5").first().x
    assert np.allclose(got, np.where(np.arange(D) == 2, 0, x[0, 1, 5]))


def test_cross_validation_of_unlike_sessions(ragged):
    _, sig, ev = ragged
    fy, score = models.cross_validate(sig, ev, ["session"], 3, 3, [1], 1e-3)
    alone, lone = models.cross_validate(renumbered(sig), ev.where("session = 1"), ["session"], 3, 3, [1], 1e-3)
    key = lambda r: (r.session, r.trial, r.samp, r.obj)
    fy, alone = fy.cache(), alone.cache()
    got, want = ({key(r): r.v for r in d.where("session = 1").collect()} for d in (fy, alone))
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)
    assert np.isclose(score.where("session = 1").first().score, lone.first().score)


def test_the_flagship_ends_where_cleaning_drops_channels(spark, small):
    got = more_queries.q_analyse_sessions(spark, small).collect()
    assert got and all(0 <= r.err <= 1 for r in got)
