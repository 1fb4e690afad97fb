import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import runs


def brute(ids, least=6, exponent=4):
    """Runs by their definition: every period, every stretch."""
    n, out = len(ids), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted((r for r in out if not any(all(ids[t] == ids[t + d] for t in range(r[0], r[0] + r[1] - d)) for d in range(1, r[2]))), key=lambda r: (r[0], r[2]))


def repeat(doc_id, words):
    """The planted texts, from the words of the contract."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 9), st.integers(0, 50), st.sampled_from([(6, 4), (2, 2), (5, 3), (12, 5)]))
def test_runs_meet_their_definition(x, p, a, rule):
    x = x[:a] + (x[a : a + p] * 60)[: len(x) - a] if x[a:] else x
    assert runs.text_runs(np.array(x, np.int64), *rule) == brute(x, *rule)


def test_words_of_runs_with_inner_runs():
    word = "a a a a a a b c ".split() * 8 + "x y".split() + "b c ".split() * 5
    ids = np.unique(word, return_inverse=True)[1]
    got = runs.text_runs(ids)
    assert got == brute(ids.tolist()) and (0, 64, 8) in got and len(got) == 10


def test_tree_and_extensions():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5):
        s = rng.integers(1, k + 1, 200)
        tree = runs.SuffixTree(s)
        closed = [*s.tolist(), 0]
        order, _ = tree.tour()
        assert order.tolist() == sorted(range(201), key=lambda i: closed[i:])
        assert tree.tour(falling=True)[0].tolist() == sorted(range(201), key=lambda i: [-c if c else -99 for c in closed[i:]])
        i, j = rng.integers(0, 201, (2, 500))
        i, j = i[i != j], j[i != j]
        same = [next(d for d in range(201) if closed[a + d] != closed[b + d]) for a, b in zip(i, j, strict=True)]
        assert runs.Extensions(tree)(i, j).tolist() == same


def test_long_texts_take_linear_time():
    rng = np.random.default_rng(5)
    assert runs.text_runs(np.zeros(150_000, np.int64)) == [(0, 150_000, 1)]
    part = rng.integers(0, 10**6, 20_000)
    assert runs.text_runs(np.concatenate([rng.integers(0, 10**6, 1000), np.resize(part, 100_000)])) == [(1000, 100_000, 20_000)]


def test_query_meets_the_contract(spark, small, tmp_path):
    texts = ["", None, " \n", "one", "w " * 7, "w " * 5, "a b " * 4, "x a b a b a b a b y", "A a " * 6, "é ü " * 9 + "end", "a\x1cb " * 6, "tok " * 20_000, "the end of it " * 3]
    rows = [(i + 13 * k, t, "c", "d") for k in range(12) for i, t in enumerate(texts)] + [(None, "z " * 9, "c", "d"), (3, "q " * 9, "c", "d"), (3, "q " * 9, "c", "d")]
    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows += [(r.doc_id + 10_000, r.text, None, None) for r in real]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, collapsed string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in rows:
        words = (t or "").encode().split()
        words = repeat(d, words) if d is not None else words
        seen = {}
        ids = [seen.setdefault(w, len(seen)) for w in words]
        found = brute(ids) if len(ids) < 3000 else runs.text_runs(np.array(ids))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        want.append((d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in runs.runs_query(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert runs.periodic_runs(df.limit(0)).count() == 0
