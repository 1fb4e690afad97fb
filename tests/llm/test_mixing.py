import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """source -> target by resharing what is over until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, whole = set(), total * sum(sizes.values())
    while True:
        left = whole - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / share for s in order}
        over = {s for s in order if s not in full and t[s] >= most * sizes[s]}
        if not over:
            return t
        full |= over


def test_words_are_counted(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\ta\n\nb\x0bc\x0c\r ", "é\x1cü x", "\xa0 y", "w " * 30_000, "x" * 200_000, "\x00 \x00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(WORD.findall(t)) for t in texts]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 5, "": 7, "Z": 300}, {"only": 9}, {"a": 0, "b": 50}, {None: 3, "é": 10, "z": 10, "zz": 2, "f": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(4)
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in got)
    assert np.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


def rows_of(seed, n, one=None):
    """Sources of unlike sizes (one holds a third or more), a very long document, copies, blank and null texts and ids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), "w " * int(rng.integers(1, 60)), str(rng.choice(["web", "web", "books", "Code", "ü"]))) for i in range(n)]
    rows += [(10**6, "x " * 9000, "web"), (10**6 + 1, None, "web"), (10**6 + 2, " \n", None), (None, "a b c", None), (None, "a b c", None), (10**6 + 3, "d e", None)]
    return rows + [(7_000_000, "same text here", "copies")] * 9001


def test_whole_plan(spark):
    rows = rows_of(1, 3000)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id bigint, text string, source string, size int, extra string")
    got = mixing.planned_rows(mixing.mix_plan(df.repartition(5))).collect()
    again = mixing.planned_rows(mixing.mix_plan(df.repartition(3))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))  # reruns agree, however the rows are dealt out
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    sizes, taken, n = defaultdict(int), defaultdict(int), Counter(s for _, _, s in rows)
    for d, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    by_target = {(sizes[s], round(want[s], 6)): s for s in sizes}
    for r in got:
        s = by_target[r.source_size, round(r.target, 6)]
        taken[s] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size and abs(r.copies - want[s] / sizes[s]) <= 1 + 1e-9
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(sizes[s] / 1000, 2 * sizes[s] / n[s], 3), s
    assert mixing.planned_rows(mixing.mix_plan(df.limit(0))).count() == 0
    none = mixing.planned_rows(mixing.mix_plan(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id bigint, text string, source string"))).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in none) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_rounding_keeps_sums_and_means(spark):
    """Every entry falls to one side, the sums stay, and over many trials each entry keeps its mass on average."""
    rng = np.random.default_rng(4)
    n, q = 200, 0.3
    sizes = rng.integers(1, 500, n)
    trials = 60  # sources of one call
    df = spark.createDataFrame([(k, i, int(a), q * float(a)) for k in range(trials) for i, a in enumerate(sizes)], "sid bigint, doc_id bigint, size bigint, mass double")
    ups, words = np.zeros(n), np.zeros(trials)
    got = mixing.pivotal_rounding(df, 9, fan=16).collect()
    assert sorted((r.sid, r.doc_id) for r in got) == [(k, i) for k in range(trials) for i in range(n)]
    for r in got:
        ups[r.doc_id] += r.up
        words[r.sid] += r.up * r.size
    assert np.abs(words - q * sizes.sum()).max() <= sizes.max()
    assert abs(ups.mean() / trials - q) < 0.02 and np.abs(ups / trials - q).max() < 0.27


def test_the_mixture_itself(spark):
    rows = rows_of(2, 300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.mix_plan(df)
    copies = Counter()
    for r in mixing.planned_rows(plan).where("taken > 0").collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed(df, plan)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == copies
