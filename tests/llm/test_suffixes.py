import hashlib
import random

import numpy as np
import pytest

from pulsegrid.llm import suffixes


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d if d is not None else -1, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("cover", [1000, 12, 4])
def test_ranks_of_suffixes(cover):
    rng = np.random.default_rng(cover)
    for n in (1, 2, 3, 4, 5, 7, 10, 50, 51, 52, 200):
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            r = suffixes.ranked(s, cover)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            for a, b in zip(order, order[1:], strict=False):
                assert r[a] < r[b] or s[a : a + cover].tolist() == s[b : b + cover].tolist(), (n, k)


def test_ranks_of_over_a_million_names():
    s = np.random.default_rng(3).integers(1, 257, 2_000_000)
    assert len(np.unique((s[:-2] * 257 + s[1:-1]) * 257 + s[2:])) > 1 << 20
    order = np.argsort(suffixes.ranked(s, 200))[:-8]
    order = order[order < len(s) - 8]
    first = sum((s[order + k] - 1).astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(8))
    assert (first[1:] >= first[:-1]).all()


@pytest.mark.parametrize("cover", [1000, 4])
def test_ranks_of_large_symbols(cover):
    rng = np.random.default_rng(cover)
    for n in range(3, 60):
        s = rng.integers(1, 4, n) << 21
        r = suffixes.ranked(s, cover)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        for a, b in zip(order, order[1:], strict=False):
            assert r[a] < r[b] or s[a : a + cover].tolist() == s[b : b + cover].tolist(), n


def rows_of():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(80), text(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, text(50)), (None, passage), (5, text(20) + passage + text(30)), (5, "same " + other), (6, "same " + other), (6, "same " + other), (7, "ab" * 400), (8, "x" * 900 + text(3))]
    for k in range(30):
        p = passage[rng.randint(0, 60) : len(passage) - rng.randint(0, 60)]
        q = list(other)
        q[rng.randrange(len(q))] = "#"
        rows.append((100 + k, text(rng.randint(0, 30)) + p + text(rng.randint(0, 30)) + "".join(q)))
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_repeats_meet_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 500)
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lo int").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.drop_repeats(df, length=100, hot=hot).collect())
    assert got == brute(rows, 100)


def test_anchors_of_many_bytes_meet_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BYTES", 500)
    rows = rows_of()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=100).collect())
    assert got == brute(rows, 100)


def test_real_documents_meet_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.drop_repeats(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 200)
    assert suffixes.drop_repeats(docs.limit(0)).count() == 0


def test_only_contexts_that_agree_beside_their_anchor_are_sorted():
    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    gram, before, behind = some(32), some(120), some(120)
    anchor = int(suffixes.gram_hashes(np.frombuffer(gram, np.uint8)).view(np.int64)[0])
    contexts = [before + gram + behind, before[-100:] + gram + some(120), some(100) + gram + behind[:120], some(70) + before[-50:] + gram + behind[:50] + some(70)]
    assert suffixes.extended(contexts, [anchor] * 4, 200).tolist() == [True, True, True, False]
    flags = suffixes.repeated_starts(contexts, 200)
    assert not flags[3].any()
    keys = rng.integers(0, 1000, 5000)
    for limit in (1000, 1 << 40):
        n, rank = suffixes.named(keys, limit)
        assert n == len(np.unique(keys)) and (rank == np.unique(keys, return_inverse=True)[1]).all()
