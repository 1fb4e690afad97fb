"""Periodic runs of words: stretches in which the same few words come again and again.

A run is a stretch with smallest period q (words q apart are equal) that cannot be extended. Every run shows at its Lyndon
root: in one of the two orders of the alphabet, the longest Lyndon word that begins somewhere in the run is its period. So the
candidates of a text are its places with the length of their longest Lyndon word, in both orders; each is extended to the
right by the longest common extension (LCE) of the places one period apart, and to the left by that of the reversed text.

Ukkonen's algorithm builds the suffix tree of the words and that of their reversal. A tour of the tree gives the string depth
at which one leaf leaves the path of the leaf before it; the LCE of two suffixes is the least of these depths between their
leaves, told in constant time by minima of blocks. The tour also gives the order of all suffixes, and with it the next
smaller suffix of each place, where its longest Lyndon word ends.

Trees are built only where a run can stand: all words of a run after its first q came before within q words, and there are
(exponent - 1) * q of them. Stretches are split at words that came never, or too long ago for the stretch that they stand in,
until nothing changes; no run is lost, and most texts keep no stretch. What is found is held against the words around it.

Memory is linear in the longest stretch of one text (some 300 bytes a word). Defined cases: a null text has no words and no
runs; a null doc_id is an id without a plant; rows that repeat are each searched; texts of any length are searched whole; an empty
table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ship

RUN = "struct<start:bigint,length:bigint,period:bigint>"
OUT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
ROWS, BLOCK = 256, 16


class SuffixTree:
    """The suffix tree of numbers over 0, closed by a 0 that stands nowhere else."""

    def __init__(self, symbols: np.ndarray):
        s = [*symbols.tolist(), 0]
        self.n, self.k = len(s), int(symbols.max(initial=0)) + 1
        self.first, self.last, go = self._grown(s, self.k)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self.parent, self.by = np.divmod(keys, self.k)
        self.child = np.fromiter(go.values(), np.int64, len(go))

    @staticmethod
    def _grown(s: list[int], k: int) -> tuple[list[int], list[int], dict[int, int]]:
        """First and last (exclusive) place of each node's edge, and the child of (node * k + symbol). The suffix that is due hangs at
        `depth` symbols below `node` on the edge that begins like place `edge`."""
        n, go = len(s), {}
        first, last, link = [0], [0], [0]
        node = edge = depth = due = 0
        for i, c in enumerate(s):
            due, new = due + 1, 0
            while due:
                if not depth:
                    edge = i
                key = node * k + s[edge]
                to = go.get(key)
                if to is None:
                    go[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    link[new], new = node, 0
                else:
                    a = first[to]
                    size = last[to] - a
                    if depth >= size:
                        node, edge, depth = to, edge + size, depth - size
                        continue
                    if s[a + depth] == c:
                        depth += 1
                        link[new] = node
                        break
                    mid = len(first)
                    first += (a, i)
                    last += (a + depth, n)
                    link += (0, 0)
                    go[key], go[mid * k + c], go[mid * k + s[a + depth]] = mid, mid + 1, to
                    first[to] = a + depth
                    link[new], new = mid, mid
                due -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth, edge = depth - 1, i - due + 1
            link[0] = 0
        return first, last, go

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in their order (falling: of the reversed alphabet, an end still before all), and for each the string depth at which it
        left the path of the one before."""
        by = np.where(self.by > 0, self.k - self.by, 0) if falling else self.by
        order = np.lexsort((by, self.parent))
        size = np.array(self.last) - np.array(self.first)
        kids, sizes = self.child[order].tolist(), size[self.child[order]].tolist()
        at = np.searchsorted(self.parent[order], np.arange(len(size) + 1)).tolist()
        suffixes, left = [], []
        todo = [(0, 0, 0)]
        while todo:
            v, depth, off = todo.pop()
            a, b = at[v], at[v + 1]
            if a == b:
                suffixes.append(self.n - depth)
                left.append(off)
            else:
                for j in range(b - 1, a, -1):
                    todo.append((kids[j], depth + sizes[j], depth))
                todo.append((kids[a], depth + sizes[a], off))
        return np.array(suffixes), np.array(left)


class LeastBetween:
    """The least of a range, in constant time and linear space: minima of blocks of BLOCK in a sparse table, and of their ends."""

    def __init__(self, x: np.ndarray):
        n = -(-len(x) // BLOCK)
        grid = np.full(n * BLOCK, np.iinfo(np.int64).max)
        grid[: len(x)] = x
        grid = grid.reshape(n, BLOCK)
        self.x = grid.ravel()
        self.to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_begin = np.minimum.accumulate(grid, axis=1).ravel()
        self.table = [grid.min(axis=1)]
        while (step := 1 << len(self.table) - 1) * 2 <= n:
            t = self.table[-1]
            self.table.append(np.minimum(t[:-step], t[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of a .. b, both ends included, a <= b."""
        p, q = a // BLOCK, b // BLOCK
        out = np.minimum(self.to_end[a], self.from_begin[b])
        gap = q - p - 1
        for level, t in enumerate(self.table):
            some = np.flatnonzero((gap >= 1 << level) & (gap < 2 << level))
            if len(some):
                out[some] = np.minimum(out[some], np.minimum(t[p[some] + 1], t[q[some] - (1 << level)]))
        inner = np.flatnonzero(p == q)
        if len(inner):
            i, j = a[inner], b[inner]
            least = self.x[i]
            for _ in range(BLOCK - 1):
                i = np.minimum(i + 1, j)
                least = np.minimum(least, self.x[i])
            out[inner] = least
        return out


class Extensions:
    """How far the suffixes at two places agree."""

    def __init__(self, tree: SuffixTree):
        self.suffixes, left = tree.tour()
        self.place = np.empty(tree.n, np.int64)
        self.place[self.suffixes] = np.arange(tree.n)
        self.least = LeastBetween(left)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of places i != j."""
        a, b = self.place[i], self.place[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller rank (their number if there is none)."""
    out, held, ranks = [len(rank)] * len(rank), [], rank.tolist()
    for i, r in enumerate(ranks):
        while held and ranks[held[-1]] > r:
            out[held.pop()] = i
        held.append(i)
    return np.array(out)


def lyndon_runs(words: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers over 0, at least `least` and exponent * period long."""
    n = len(words)
    tree = SuffixTree(words)
    ahead = Extensions(tree)
    ranks = [ahead.place, np.empty(n + 1, np.int64)]
    ranks[1][tree.tour(falling=True)[0]] = np.arange(n + 1)
    del tree
    at, period = [], []
    for rank in ranks:
        p = next_smaller(rank)[:n] - np.arange(n)
        some = np.flatnonzero((p * exponent <= n) & (np.arange(n) + p < n))
        at.append(some)
        period.append(p[some])
    at, period = np.concatenate(at), np.concatenate(period)
    right = ahead(at, at + period)
    keep = right > (exponent - 2) * period  # of a run's first root the left side is less than a period
    at, period, right = at[keep], period[keep], right[keep]
    del ahead
    back = Extensions(SuffixTree(words[::-1]))
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    left[inner] = back(n - at[inner], n - at[inner] - period[inner])
    rows = np.stack([at - left, left + period + right, period], axis=1)
    rows = rows[rows[:, 1] >= np.maximum(least, exponent * rows[:, 2])]
    return np.unique(rows, axis=0)


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Where the words of runs after their first period can stand: places whose word came before within 1 / (exponent - 1) of the
    stretch."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ago = np.full(n, n * exponent, np.int64)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    ago[order[same + 1]] = order[same + 1] - order[same]
    shortest = max(1, least * (exponent - 1) // exponent)
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        far = np.flatnonzero(ago[a:b] * (exponent - 1) > b - a)
        if not len(far):
            out.append((a, b))
            continue
        edges = np.concatenate([[-1], far, [b - a]]) + a
        wide = np.flatnonzero(np.diff(edges) > shortest)
        todo += [(x + 1, y) for x, y in zip(edges[wide].tolist(), edges[wide + 1].tolist(), strict=True)]
    return out


def text_runs(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n, found = len(ids), set()
    if n < least:
        return []
    for a, b in stretches(ids, least, exponent):
        low = max(0, a - (b - a) // (exponent - 1))
        part = np.unique(ids[low:b], return_inverse=True)[1] + 1
        for s, size, q in lyndon_runs(part, least, exponent).tolist():
            s += low
            e = s + size
            # at the edge of a stretch a run may go on: then it is whole in another one
            if (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == n or ids[e] != ids[e - q]):
                found.add((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text of ten, chosen by the checksum of its id, repeats itself from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, some = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if some:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _search(least: int, exponent: int, plant: Callable | None):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(doc_id, text: str | None) -> tuple[int, np.ndarray, bytes]:
        words = (text or "").encode().split()
        if plant:
            words = plant(doc_id, words)
        seen: dict[bytes, int] = {}
        ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))  # a word's number is its first place
        runs = text_runs(ids, least, exponent)
        if runs:
            step = np.zeros(len(words) + 1, np.int64)
            for s, size, q in runs:
                step[s + q] += 1
                step[s + size] -= 1
            words = [w for w, k in zip(words, np.cumsum(step).tolist(), strict=False) if not k]
        return len(ids), np.array(runs, np.int64).reshape(-1, 3), b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                n, runs, kept = zip(*(one(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), strict=True)
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, plant: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) of at least `least` words and `exponent` periods, and collapsed: the text less what
    repeats the first period of a run, its words joined by a space. plant may change the words of a text first."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_search(least, exponent, plant), OUT)


def longest(runs: Column) -> Column:
    """The longest run; the first on ties, then that of the least period."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))


def runs_query(spark, sf_dir: str) -> DataFrame:
    d = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=planted)
    d = d.withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
