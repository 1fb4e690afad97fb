"""Benchmark decontamination by an exact word filter and longest common subsequences.

Texts are cut into passages of `window` words, half overlapping; a region is a passage with half a window on either side.
A benchmark passage leaks into a region when their longest common subsequence covers a high share of it, or a middling
share if the answer words (the passage's rarest words, by their frequency in all texts) are there too, as in a paraphrase.

Candidates are complete. A high share leaves few places of the passage unmatched, so of its rarest words that cover one
place more than that, one stands in the region; a middling share needs most answer words, so of the rarest few of them
one stands there too. The index posts each passage under those words only. Regions meet the passages posted under their
words, the number of places and answer words that a region can match is counted, and what still can be a leak is checked.

The benchmark is the query set: it is taken in blocks of BLOCK_CHARS characters, each broadcast on its own.

A benchmark row of fewer than min_words words leaks only where all its words stand in a row: a few common words in order
within a region are no sign of it.

Defined cases: a null or empty text has no passage and is clean; benchmark rows with a null item_id or without a word are
left out; repeated rows return as often as they stand; an empty benchmark leaves all clean; an empty
table gives an empty result; columns other than doc_id, text (item_id, text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import WordHashes, map_rows, mix, ship

FEATURES, BLOCK_CHARS, PARTS = 1 << 15, 1 << 24, 16
GROUP, HITS, CELLS = 200_000, 1 << 21, 1 << 22
PUNCT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz" + b" " * 31)


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation; ASCII letters in lower case."""
    return (text or "").encode().translate(PUNCT).split()


def features(words: list[bytes], hashes: WordHashes | None = None) -> np.ndarray:
    return ((WordHashes() if hashes is None else hashes).of(words) >> np.uint64(49)).astype(np.int64)


def lcs(pattern: dict, m: int, words: list) -> int:
    """Length of the longest common subsequence, by bits. pattern: the places of each word of the pattern."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if (p := pattern.get(w)) is not None:
            u = v & p
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _frequencies(step: int):
    """Each task's count of blocks of `step` words that hold a feature, as compressed slices of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks, hashes = np.zeros(FEATURES, np.int64), 0, WordHashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                cuts = [words_of(t) for t in b.column(0).slice(k, 256).to_pylist()]
                n = np.array([len(c) for c in cuts])
                f = features([w for c in cuts for w in c], hashes)
                at = np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n)
                per = -(-n // step)
                block = np.repeat(np.cumsum(per) - per, n) + at // step
                total += np.bincount(np.unique(block * FEATURES + f) % FEATURES, minlength=FEATURES)
                blocks += int(per.sum())
        for p, x in enumerate(np.split(total, PARTS)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "blocks": pa.array([blocks if p == 0 else 0], pa.int64()), "counts": pa.array([x.tobytes()], pa.binary())})

    return run


def _added(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        blocks: dict[int, int] = {}
        for b in batches:
            for p, k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(c, kind)
                sums[p] = sums[p] + x if p in sums else x
                blocks[p] = blocks.get(p, 0) + k
        for p, x in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "blocks": pa.array([blocks[p]], pa.int64()), "counts": pa.array([x.tobytes()], pa.binary())})

    return run


SLICES = "part int, blocks bigint, counts binary"


def summed(slices: DataFrame, kind) -> tuple[np.ndarray, int]:
    """The sum of all tasks' slices: a fixed number of values, whatever the corpus."""
    rows = slices.repartition(PARTS, "part").mapInArrow(_added(kind), SLICES).collect()
    got: dict[int, np.ndarray] = {}
    for r in rows:
        got[r["part"]] = np.frombuffer(bytes(r["counts"]), kind)
    return np.concatenate([got[p] for p in sorted(got)]) if got else np.empty(0, kind), sum(r["blocks"] for r in rows)


def inverse_frequencies(docs: DataFrame, step: int) -> np.ndarray:
    """log(blocks / frequency) of each feature, however common."""
    ship(docs.sparkSession)
    df, blocks = summed(docs.select("text").mapInArrow(_frequencies(step), SLICES), np.int64)
    if not len(df):
        df = np.zeros(FEATURES, np.int64)
    return np.log((blocks + 1) / (df + 1)).astype(np.float32)


def passages(text: str | None, window: int, min_words: int) -> list[list[bytes]]:
    w = words_of(text)
    step = window // 2
    return [p for k in range(0, max(1, len(w) - step), step) if len(p := w[k : k + window]) >= min_words]


def _least(share: float, n: int) -> int:
    """The least count, 1 at least, that is this share of n."""
    k = max(1, int(share * n) - 1)
    while k < share * n:
        k += 1
    return k


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 of each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _sequence_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each place."""
    h = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(3) + word[j : j + len(h)].astype(np.uint64))
    return h


class Vocabulary(dict):
    """Numbers of the benchmark's words from 2; 0 pads, 1 is any other word."""

    def __missing__(self, word: bytes) -> int:
        return 1


class Items:
    """The passages of one block of the benchmark and their index."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, window: int, min_words: int, high: float, low: float, answer: float, answer_share: float):
        self.step, self.window, self.high, self.low, self.answer = window // 2, window, high, low, answer
        self.vocabulary, self.ids, self.sequences, self.places = Vocabulary(), [], [], {}
        hashes, posts, distinct = WordHashes(), [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by size, of items under min_words: the items of a sequence
        for item, text in rows:
            if 0 < len(w := words_of(text)) < min_words:
                key = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in w], np.int64).tobytes()
                self.short.setdefault(len(w), {}).setdefault(key, []).append(item)
            for p in passages(text, window, min_words):
                weight = idf[features(p, hashes)]
                order = np.argsort(-weight, kind="stable")
                word = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in p]
                counts: dict[int, int] = {}
                for w in word:
                    counts[w] = counts.get(w, 0) + 1
                rarest = list(dict.fromkeys(word[i] for i in order))
                answers = list(dict.fromkeys(word[i] for i in order[: max(1, round(len(p) * answer_share))]))
                posted, free = set(answers[: len(answers) - _least(answer, len(answers)) + 1]), len(p) - _least(high, len(p))
                for w in rarest:
                    posted.add(w)
                    free -= counts[w]
                    if free < 0:
                        break
                posts.extend((w, len(self.ids)) for w in posted)
                distinct.append((counts, set(answers)))
                self.ids.append(item)
                self.sequences.append(np.array(word, np.int32))
        self.short_hashes = {n: np.concatenate([_sequence_hashes(np.frombuffer(x, np.int64), n) for x in table]) for n, table in self.short.items()}
        self.width, k = len(self.vocabulary) + 2, len(self.ids)
        most = max((len(c) for c, _ in distinct), default=0)
        self.words, self.counts, self.is_answer = np.zeros((k, most), np.int32), np.zeros((k, most), np.uint16), np.zeros((k, most), bool)
        for i, (c, a) in enumerate(distinct):
            self.words[i, : len(c)], self.counts[i, : len(c)], self.is_answer[i, : len(c)] = list(c), list(c.values()), [w in a for w in c]
        self.sizes, self.answers = np.array([len(x) for x in self.sequences]), self.is_answer.sum(1)
        post = np.array(sorted(posts), np.int64).reshape(-1, 2)
        self.posted = np.bincount(post[:, 0], minlength=self.width)
        self.first, self.post = np.cumsum(self.posted) - self.posted, post[:, 1]

    def share(self, k: int, region: np.ndarray) -> float:
        """The LCS share of passage k in the region."""
        if (places := self.places.get(k)) is None:
            places = self.places[k] = {}
            for i, w in enumerate(self.sequences[k].tolist()):
                places[w] = places.get(w, 0) | 1 << i
        return lcs(places, int(self.sizes[k]), region.tolist()) / int(self.sizes[k])

    def candidates(self, word: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of texts of n words each: text, first word and end of a region, and a passage that shares a posted word with it."""
        per = -(-n // self.step)
        base, begin, last = np.cumsum(per) - per, np.cumsum(n) - n, np.maximum(per - 1, 1)
        text = np.repeat(np.arange(len(n)), per)
        block = np.repeat(base, n) + _ramp(n) // self.step
        some = self.posted[word] > 0
        at, w = np.divmod(np.unique(block[some] * self.width + word[some]), self.width)
        total = np.cumsum(self.posted[w])
        for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(total // HITS)) + 1):
            c = self.posted[w[part]]
            k = self.post[np.repeat(self.first[w[part]], c) + _ramp(c)]
            b, k = np.divmod(np.unique(np.repeat(at[part], c) * len(self.ids) + k), len(self.ids))
            t = text[b]
            near = [(b + d, (b + d >= base[t]) & (b + d < base[t] + last[t])) for d in range(-2 - self.window % 2, 2)]
            r, k = np.divmod(np.unique(np.concatenate([r[ok] * len(self.ids) + k[ok] for r, ok in near])), len(self.ids))
            t = text[r]
            place = (r - base[t]) * self.step
            yield t, begin[t] + np.maximum(place - self.step, 0), begin[t] + np.minimum(place + self.window + self.step, n[t]), k

    def leaks(self, word: np.ndarray, n: np.ndarray) -> list[dict[int, float]]:
        """The leaked items of each text with their LCS shares."""
        best: list[dict[int, float]] = [{} for _ in n]
        owner = np.repeat(np.arange(len(n)), n)
        for size, table in self.short.items():
            h = _sequence_hashes(word, size)
            for i in np.flatnonzero(np.isin(h, self.short_hashes[size]) & (owner[: len(h)] == owner[size - 1 :][: len(h)])).tolist():
                best[owner[i]].update(dict.fromkeys(table.get(word[i : i + size].tobytes(), ()), 1.0))
        if not self.ids:
            return best
        most = max(1, CELLS // self.width)
        for t, lo, hi, k in self.candidates(word, n):
            fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(t)]
            region = np.cumsum(fresh) - 1
            for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(region // most)) + 1):
                if not len(part):
                    continue
                local, heads = region[part] - region[part[0]], part[fresh[part]]
                size = hi[heads] - lo[heads]
                have = np.zeros((len(heads), self.width), bool)
                have[np.repeat(np.arange(len(heads)), size), word[np.repeat(lo[heads], size) + _ramp(size)]] = True
                for few in np.split(np.arange(len(part)), range(1 << 16, len(part), 1 << 16)):
                    q = k[part[few]]
                    there = have[local[few][:, None], self.words[q]]
                    bound = (there * self.counts[q]).sum(1) / self.sizes[q]
                    answered = (there & self.is_answer[q]).sum(1) >= self.answer * self.answers[q]
                    able = np.flatnonzero((bound >= self.high) | (bound >= self.low) & answered)
                    for i in able.tolist():
                        j, item = part[few[i]], self.ids[q[i]]
                        known = best[t[j]].get(item, 0.0)
                        if known < 1.0:
                            share = self.share(int(q[i]), word[lo[j] : hi[j]])
                            if share > known and (share >= self.high or share >= self.low and answered[i]):
                                best[t[j]][item] = share
        return best


def _search(items):
    def make():
        def fn(c: dict) -> dict:
            known, ids, scores = items.value, [], []
            held: list[np.ndarray] = []

            def flush():
                n = np.array([len(x) for x in held])
                for a, best in zip(c["item_ids"][len(ids) : len(ids) + len(held)], known.leaks(np.concatenate(held), n), strict=True):
                    scores.append(c["scores"][len(ids)] + [round(best[i], 6) for i in sorted(best)])
                    ids.append(a + sorted(best))
                held.clear()

            size = 0
            for t in c["text"]:
                w = words_of(t)
                held.append(np.fromiter(map(known.vocabulary.__getitem__, w), np.int64, len(w)))
                size += len(w)
                if size > GROUP:
                    flush()
                    size = 0
            if held:
                flush()
            return {k: c[k] for k in c if k not in ("item_ids", "scores")} | {"item_ids": ids, "scores": scores}

        return fn

    return make


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 64, high: float = 0.75, low: float = 0.5, answer: float = 0.8, answer_share: float = 0.25, min_words: int = 8) -> DataFrame:
    """All columns of docs as a struct `doc`, with item_ids, scores (LCS share of each) and contaminated."""
    spark = docs.sparkSession
    ship(spark)
    given = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    idf = inverse_frequencies(docs, window // 2)
    out = docs.select("text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("doc"), F.array().cast("array<bigint>").alias("item_ids"), F.array().cast("array<double>").alias("scores"))
    kinds = dict(out.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in out.columns)
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        block = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about BLOCK_CHARS characters
        items = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in block], idf, window, min_words, high, low, answer, answer_share))
        out = map_rows(out, _search(items), schema)
    return out.withColumn("contaminated", F.size("item_ids") > 0)


def leaks_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc.doc_id", "contaminated", "item_ids", "scores")
