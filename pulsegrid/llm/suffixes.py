"""Exact repeated-substring removal by suffix arrays with a difference cover.

Sorting every suffix of a corpus moves many times its size. So the suffixes are dealt out first by a content-defined
sample: the anchor of a window of `length` bytes is its place of least hash over 32 bytes, leftmost on ties. Two equal
windows have the same anchor at the same place, so only windows whose anchor's 32 bytes occur twice in the corpus can
repeat, and windows of different anchors never meet. Of each anchor that occurs twice, the text that its windows cover is
sent to the anchor's task. There the difference-cover algorithm sorts the suffixes: sampled triples (places 1 and 2 modulo
3) are sorted and named, the algorithm recurses on the string of names until they are distinct or cover the length, the
remaining suffixes are sorted by their first byte and the next rank and merged, and adjacent suffixes are compared on
their first `length` bytes.

Equal contexts are combined before the shuffle, so a passage in very many documents sends one row a slice. Anchors that
still have more than HOT contexts, or HOT_BYTES bytes of them, are not gathered: their windows are spread by their own fingerprints, counted with a
partial aggregate and joined back.

Defined cases: a null or empty text has no bytes; texts shorter than the length lose nothing; a text may match itself, also
where the places overlap; exact repeats of a row are separate documents and remove each other; texts of any length are read
whole (in overlapping segments); a null doc_id is a document like any other; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import among, bit_map, cut, map_rows, mix, opened, ship

GRAM, SEGMENT, BUFFER, HOT, HOT_BYTES, CHUNK = 32, 1 << 21, 1 << 22, 20_000, 1 << 22, 1 << 20
RUNS = "doc_id bigint, th bigint, lo bigint, hi bigint"
CONTEXTS = "anchor bigint, doc_id bigint, th bigint, lo bigint, hi bigint, many boolean, context binary"


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place; GRAM is a power of two."""
    h, k = mix(a.astype(np.uint64) + np.uint64(1)), 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] if len(h) > k else h[:0]
            h ^= h >> np.uint64(31)
            k *= 2
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])


def segments(texts: list[str | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (place of the text, offset, bytes): the windows of all segments are those of all texts, each once."""
    group, size = [], 0
    for i, t in enumerate(texts):
        b = t.encode() if t else b""
        for at in range(0, max(1, len(b) - length + 1), SEGMENT):
            piece = b[at : at + SEGMENT + length - 1]
            if len(piece) >= length:
                group.append((i, at, piece))
                size += len(piece)
                if size >= BUFFER:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def anchored(group: list[tuple[int, int, bytes]], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's bytes and its runs of window starts with one anchor: first start, last start, anchor hash, segment."""
    data = b"".join(p for _, _, p in group)
    n = np.array([len(p) for _, _, p in group])
    h = gram_hashes(np.frombuffer(data, np.uint8))
    placed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(placed, length - GRAM + 1) & np.uint64((1 << 24) - 1)
    owner = np.repeat(np.arange(len(n)), n)[: len(least)]
    end = np.cumsum(n)
    valid = np.arange(len(least)) + length <= end[owner]
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    lo, hi = edges[:-1], edges[1:] - 1
    good = valid[lo]
    lo, hi = lo[good], hi[good]
    return data, lo, hi, h[least[lo].astype(np.int64)], owner[lo]


def _anchors(length: int):
    """Each task's distinct anchor hashes, and whether the task has them twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        def flush():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.minimum(c, 2).astype(np.int64))], names=["anchor", "n"])

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                for group in segments(b.column(0).slice(k, 1024).to_pylist(), length):
                    held.append(anchored(group, length)[3])
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _contexts(bits, length: int):
    """Rows of repeated anchors with the text that their windows cover. Of equal contexts in a slice one is sent, marked
    `many`; all their runs are known to repeat and are returned without context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(bits.value)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                ids, ths = part.column(0).to_pylist(), part.column(1).to_pylist()
                for group in segments(part.column(2).to_pylist(), length):
                    data, lo, hi, anchor, seg = anchored(group, length)
                    some = np.flatnonzero(among(known, anchor))
                    start = np.cumsum([0, *(len(p) for _, _, p in group)])
                    seen: dict[bytes, list] = {}
                    out: list[list] = []
                    for a, x, y, s in zip(anchor[some].view(np.int64).tolist(), lo[some].tolist(), hi[some].tolist(), seg[some].tolist(), strict=True):
                        i, offset, _ = group[s]
                        base, ctx = offset - int(start[s]), data[x : y + length]
                        row = [a, ids[i], ths[i], base + x, base + y, False, ctx]
                        first = seen.setdefault(ctx, row)
                        if first is row:
                            out.append(row)
                        else:
                            first[5] = True
                            out.append([None, ids[i], ths[i], base + x, base + y, True, None])
                    if out:
                        cols = list(zip(*out, strict=True))
                        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "doc_id", "th", "lo", "hi", "many", "context"])

    return run


def named(keys: np.ndarray, limit: int) -> tuple[int, np.ndarray]:
    """The number of distinct keys (under limit) and the rank of each from 0: by a table where it is small, else by sorting."""
    if limit > max(4 * len(keys), 1 << 16):
        names, rank = np.unique(keys, return_inverse=True)
        return len(names), rank
    there = np.zeros(limit, bool)
    there[keys] = True
    rank = np.cumsum(there, dtype=np.int32)
    return int(rank[-1]), rank[keys].astype(np.int64) - 1


def extended(contexts: list[bytes], anchors: list[int], length: int) -> np.ndarray:
    """Which contexts may hold a window of another one of their anchor. Such a window has (length - GRAM) / 2 bytes or more before
    or behind the anchor, so the other one agrees on so many bytes there; all others cannot repeat and need no sorting."""
    side = -(-(length - GRAM) // 2)
    keep = np.zeros(len(contexts), bool)
    data = b"".join(contexts)
    h = gram_hashes(np.frombuffer(data, np.uint8))
    begin = 0
    seen: dict[tuple, int] = {}
    for k, (ctx, anchor) in enumerate(zip(contexts, anchors, strict=True)):
        m = len(ctx)
        lo, hi = max(0, m - length), min(length, m) - GRAM  # every window covers the anchor
        places = lo + np.flatnonzero(h[begin + lo : begin + hi + 1].view(np.int64) == anchor)
        begin += m
        if not len(places):
            keep[k] = True
        for p in places.tolist():
            for key in ((anchor, 0, ctx[p - side : p]) if p >= side else None, (anchor, 1, ctx[p + GRAM : p + GRAM + side]) if m - p - GRAM >= side else None):
                if key is not None:
                    other = seen.setdefault(key, k)
                    if other != k:
                        keep[other] = keep[k] = True
    return keep


def ranked(s: np.ndarray, cover: int) -> np.ndarray:
    """Rank of each suffix of s by the difference cover {1, 2} modulo 3. Suffixes that agree on `cover` symbols stand
    together, in any order or with one rank; all others are in order. s holds positive integers."""
    n = len(s)
    if n < 3:
        keys = [tuple(s[i:].tolist()) for i in range(n)]
        order = {k: r for r, k in enumerate(sorted(set(keys)))}
        return np.array([order[k] + 1 for k in keys], np.int64)
    x = np.zeros(n + 3, np.int64)
    x[:n] = s
    size = int(x.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place past the end keeps the cover whole
    sample = np.concatenate([one, two])
    by_pair = lambda i: x[i] * size + x[i + 1]  # noqa: E731  under 2^62: symbols are ranks in an array, under 2^31
    if size >= 1 << 20:  # a triple of large symbols does not fit 63 bits: pairs are named first, here and below
        pairs = np.unique(by_pair(np.arange(n + 1)))
        by_pair = lambda i: np.searchsorted(pairs, x[i] * size + x[i + 1])
    names, inverse = named(by_pair(sample) * size + x[sample + 2], size**3)
    inverse = inverse + 1
    if names < len(sample) and cover > 3:
        inverse = ranked(np.concatenate([inverse[: len(one)], [0], inverse[len(one) :]]) + 1, -(-cover // 3))
        inverse = np.concatenate([inverse[: len(one)], inverse[len(one) + 1 :]])
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = inverse
    big = int(rank.max()) + 1
    rest = np.arange(0, n, 3)
    by_one = lambda i: x[i] * big + rank[i + 1]  # noqa: E731  against places 1 modulo 3
    by_two = lambda i: by_pair(i) * big + rank[i + 2]  # noqa: E731  against places 2 modulo 3
    one, two = one[one < n], two[two < n]
    # the place of each suffix among the others: of its own class by rank, of the other classes by search
    own_one, own_two, own_rest = np.sort(rank[one]), np.sort(rank[two]), np.sort(by_one(rest))
    rest_two = np.sort(by_two(rest))
    key_one, key_two = np.sort(by_one(one)), np.sort(by_two(two))
    out = np.empty(n, np.int64)
    for at, own in ((one, own_one), (two, own_two)):
        other = own_two if own is own_one else own_one
        out[at] = np.searchsorted(own, rank[at]) + np.searchsorted(other, rank[at])
    out[one] += np.searchsorted(own_rest, by_one(one))
    out[two] += np.searchsorted(rest_two, by_two(two))
    out[rest] = np.searchsorted(own_rest, by_one(rest)) + np.searchsorted(key_one, by_one(rest)) + np.searchsorted(key_two, by_two(rest))
    return out + 1


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Of distinct contexts: which of their window starts have a window that stands elsewhere among them."""
    n = np.array([len(c) for c in contexts])
    data = b"\0".join(contexts) + bytes(length + 8)
    a = np.frombuffer(data, np.uint8)
    begin = np.cumsum(n + 1) - (n + 1)
    total = int((n + 1).sum()) - 1
    s = 1 + named(a[:total].astype(np.int64), 256)[1] + 1  # few symbols: triples of bytes are named by a table
    s[begin[1:] - 1] = 1
    rank = ranked(s, length)
    own = n - length + 1
    starts = np.repeat(begin, own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    order = np.argsort(rank[starts], kind="stable")
    sorted_ = starts[order]
    words = np.lib.stride_tricks.sliding_window_view(a, 8)[: total + length].copy().view(np.uint64).ravel() if total else np.empty(0, np.uint64)
    pair = np.arange(len(sorted_) - 1)
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else None
    for k in steps or range(length):
        left = (words if steps else a)[sorted_[pair] + k] == (words if steps else a)[sorted_[pair + 1] + k]
        pair = pair[left]
    hit = np.zeros(len(sorted_), bool)
    hit[pair] = True
    hit[pair + 1] = True
    flags = np.zeros(len(starts), bool)
    flags[order] = hit
    return np.split(flags, np.cumsum(own)[:-1])


def _sorted_runs(length: int):
    """Runs of repeated starts. The rows of a partition come in order of anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        size = 0

        def flush():
            nonlocal size
            out = []
            whole = lambda rows: out.extend((d, t, lo, hi) for d, t, lo, hi, _ in rows)
            unlike, owners = [], []
            for a, by_text in held.items():
                if len(by_text) > 1:
                    unlike.extend((c, rows) for c, rows in by_text.items())
                    owners.extend([a] * len(by_text))
                else:
                    for rows in by_text.values():
                        if len(rows) > 1 or rows[0][4]:
                            whole(rows)
            if unlike:
                able = extended([c for c, _ in unlike], owners, length)
                for (_, rows), some in zip(unlike, able.tolist(), strict=True):
                    if not some and (len(rows) > 1 or rows[0][4]):
                        whole(rows)
                unlike = [x for x, some in zip(unlike, able.tolist(), strict=True) if some]
            if unlike:
                for (_, rows), flags in zip(unlike, repeated_starts([c for c, _ in unlike], length), strict=True):
                    if len(rows) > 1 or rows[0][4] or flags.all():
                        whole(rows)
                    elif flags.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                            out.extend((d, t, lo + x, lo + y - 1) for d, t, lo, _, _ in rows)
            held.clear()
            size = 0
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "th", "lo", "hi"])

        last = None
        for b in batches:
            for a, d, t, lo, hi, many, ctx in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if a != last and size > CHUNK:
                    yield flush()
                last = a
                rows = held.setdefault(a, {}).setdefault(ctx, [])
                if not rows:
                    size += len(ctx)
                rows.append((d, t, lo, hi, many))
        if held:
            yield flush()

    return run


def _windows(length: int):
    """Fingerprints of all windows of hot contexts."""

    def make():
        def fn(c: dict) -> dict:
            out: dict = {k: [] for k in ("f1", "doc_id", "th", "lo", "many")}
            for d, t, lo, many, ctx in zip(c["doc_id"], c["th"], c["lo"], c["many"], c["context"], strict=True):
                for k in range(len(ctx) - length + 1):
                    out["f1"].append(hashlib.blake2b(ctx[k : k + length], digest_size=16).digest())
                    out["doc_id"].append(d)
                    out["th"].append(t)
                    out["lo"].append(lo + k)
                    out["many"].append(many)
            return out

        return fn

    return make


def repeated_runs(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc_id, th, lo, hi): the window starts lo..hi of a document whose windows stand elsewhere too."""
    spark = docs.sparkSession
    ship(spark)
    repeated = docs.select("text").mapInArrow(_anchors(length), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    bits = spark.sparkContext.broadcast(bit_map(repeated))
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_contexts(bits, length), CONTEXTS), "contexts")
    known = rows.where("many").select("doc_id", "th", "lo", "hi")
    sent = rows.where("context is not null")
    hot_ones = cut(sent.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("bytes")).where((F.col("n") > hot) | (F.col("bytes") > HOT_BYTES)).select("anchor"), "hot")
    parts = [known]
    cool = sent.join(hot_ones, "anchor", "left_anti").select(*rows.columns)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts.append(cool.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_runs(length), RUNS))
    if not hot_ones.isEmpty():
        w = map_rows(sent.join(hot_ones, "anchor", "left_semi").select("doc_id", "th", "lo", "many", "context"), _windows(length), "f1 binary, doc_id bigint, th bigint, lo bigint, many boolean", rows=64)
        w = cut(w, "windows")
        twice = w.groupBy("f1").agg((F.count("*") + F.max(F.col("many").cast("int"))).alias("n")).where("n > 1").select("f1")
        parts.append(w.join(twice, "f1").select("doc_id", "th", "lo", F.col("lo").alias("hi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _kept(length: int):
    def make():
        def fn(c: dict) -> dict:
            out: dict = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
            for t, runs in zip(c["text"], c["runs"], strict=True):
                b = t.encode() if t else b""
                keep, at, spans = [], 0, 0
                end = -1
                for r in sorted((r["lo"], r["hi"]) for r in runs or ()):
                    if r[0] > end:
                        keep.append(b[at : r[0]])
                        spans += 1
                    end = max(end, r[1] + length)
                    at = end
                keep.append(b[at:])
                left = b"".join(keep)
                out["n_bytes"].append(len(b))
                out["n_removed"].append(len(b) - len(left))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept_bytes"].append(left)
            return out | {"doc_id": c["doc_id"]}

        return fn

    return make


def drop_repeats(docs: DataFrame, length: int = 200, with_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_bytes, kept_bytes of each document."""
    runs = repeated_runs(docs, length, hot).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # at most the bytes of one text
    runs = runs.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "runs")
    th = F.xxhash64("text")
    j = docs.select("doc_id", "text").join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & (th == F.col("t")), "left").select("doc_id", "text", "runs")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return map_rows(j, _kept(length), schema)


def repeats_query(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
