"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.shared import cut, forget, shared_dir, ship, table  # noqa: F401  used by the operators

#: The white space that ends a word (space, tab to carriage return); bytes.split() uses the same six.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What this Python worker keeps for its next tasks (one thing at most), and the stage of the last task.
_KEPT: dict[Hashable, Any] = {}
_STAGE: list = [None]


def trim() -> None:
    """Freed memory goes back to the system: workers outlive their tasks, and an idle one should take little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def let_go() -> None:
    """What a task of another stage left goes."""
    stage = t.stageId() if (t := TaskContext.get()) else None
    if _KEPT and stage != _STAGE[0]:
        _KEPT.clear()
        trim()
    _STAGE[0] = stage


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), held for the next tasks of a stage that ask for the same key."""
    if key not in _KEPT:
        let_go()
        if _KEPT:
            _KEPT.clear()
            trim()
        _KEPT[key] = make()
    return _KEPT[key]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers neither keep what other stages left nor, at a task's end, the memory that it freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow in slices of so many rows, so that a task holds few texts at once. make() runs once a task and
    returns the function from a dict of input columns (lists) to a dict of output columns."""
    ship(df.sparkSession)
    out_schema = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([a if isinstance(a := got[f.name], pa.Array) else pa.array(a, f.type) for f in out_schema], schema=out_schema)

    return map_batches(df, run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b): component is the smallest node reachable.
    Alternates large and small stars; every step is a partial aggregate and a join that the adaptive planner can
    split, so a node with very many neighbours does not meet in one task. Self loops keep lone nodes."""
    e = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    first, before = e, None
    loops = e.where("u = v").select("u")
    e = e.where("u <> v")
    held = first
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(low, "u")
        e = cut(e2.select(F.col("u"), F.col("m").alias("v")).union(e2.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        if held is not first:
            forget(held)
        held = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    linked = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return linked.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(loops.selectExpr("u as node", "u as component")).groupBy("node").agg(F.min("component").alias("component"))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number: most words of a text were met before."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BITS, SLICES = 1 << 27, 16


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a task's bits, each once a batch."""
    for b in batches:
        at = np.unique((b.column(0).to_numpy().view(np.uint64) & np.uint64(BITS - 1)).astype(np.uint32))
        ends = np.searchsorted(at, np.arange(1, SLICES) * (BITS // SLICES))
        found = [(p, x) for p, x in enumerate(np.split(at, ends)) if len(x)]
        if found:
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.int32()), "bits": pa.array([x.tobytes() for _, x in found], pa.binary())})


def _joined_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, np.ndarray] = {}
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p not in got:
                got[p] = np.zeros(BITS // SLICES, bool)
            got[p][np.frombuffer(x, np.uint32) - np.uint32(p * (BITS // SLICES))] = True
    for p, x in got.items():
        x = np.packbits(x, bitorder="little")
        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bits": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})


def bit_map(hashes: DataFrame) -> tuple[bytes, ...]:
    """The low bits of a column of hashes as a bit map of BITS bits, SLICES compressed slices: at most 16 MB, whatever the corpus, and the
    driver opens none of them. It only saves work: what is not in it is not among the hashes, what is in it must still be joined; more hashes let more
    through."""
    ship(hashes.sparkSession)
    places = map_batches(hashes, _bits, "part int, bits binary").repartition(SLICES, "part")
    return slices(map_batches(places, _joined_bits, "part int, bits binary").collect(), SLICES)


def slices(rows: list, n: int) -> tuple[bytes, ...]:
    """The n compressed slices of collected rows (part, bytes), which are used up; one that has no row is empty."""
    out = [b""] * n
    while rows:
        part, x = rows.pop()
        out[part] = bytes(x)
    return tuple(out)


def joined(parts: tuple[bytes, ...], size: int) -> np.ndarray:
    """The bytes of slices of `size` bytes each."""
    out = np.zeros((len(parts), size), np.uint8)
    for row, x in zip(out, parts, strict=True):
        if x:
            row[:] = np.frombuffer(zlib.decompress(x), np.uint8)
    return out.ravel()


def opened(bits: tuple[bytes, ...]) -> np.ndarray:
    """Opened once a worker and stage: its next tasks get the same bytes."""
    return kept(("bits", bits), lambda: joined(bits, BITS // 8 // SLICES))


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def maybe_among(df: DataFrame, hashes: DataFrame, column) -> DataFrame:
    """The rows of df whose column (a hash) may be among hashes: only that column goes through Python. `bits` of the result is its bit map,
    which the caller may destroy once the rows were written."""
    bits = df.sparkSession.sparkContext.broadcast(bit_map(hashes))
    out = df.where(maybe_in(bits)(column))
    out.bits = bits
    return out


def maybe_in(bits):
    """A function of a column of hashes: whether each may be in the broadcast bit map."""

    @F.pandas_udf("boolean")
    def hit(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = opened(bits.value)
        for x in columns:
            yield pd.Series(among(known, x.fillna(0).to_numpy(np.int64)))

    return hit


PIECE = 1 << 15
_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, upper-case ASCII letters like lower-case ones, and the powers of an odd base.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C13
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER = [_powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the place where each text begins (one place more than texts); nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None or not len(column) else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    if column.null_count and len(column):  # a null may cover bytes
        n = np.diff(at)
        gone = column.is_null().to_numpy(zero_copy_only=False) & (n > 0)
        if gone.any():
            data = data[~np.repeat(gone, n)]
            at = np.concatenate([[0], np.cumsum(np.where(gone, 0, n))])
    return data, at - at[0] if len(at) else np.zeros(1, np.int64)


def hashed_words(data: np.ndarray, at: np.ndarray, white: np.ndarray = _IS_WHITE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and 64-bit hash (of the lower-cased bytes) of each word of the texts that begin at `at`. Works in pieces
    of PIECE bytes that end at white space, so that only a single longer word takes more memory."""
    starts, hashes, lo, total = [], [], 0, len(data)
    cuts = np.unique(at)
    room = np.empty((2, PIECE + 1), np.uint64)  # fresh memory a piece costs more than the sums
    while lo < total:
        hi = min(total, lo + PIECE)
        while hi < total and not white[data[hi]]:
            step = np.flatnonzero(white[data[hi : hi + PIECE]])
            hi = hi + int(step[0]) if len(step) else min(total, hi + PIECE)
        part = data[lo:hi]
        solid = np.zeros(len(part) + 2, bool)
        if white is _IS_WHITE:  # comparisons of bytes are cheaper than a table
            np.logical_and(part != 32, part - np.uint8(9) > 4, out=solid[1:-1])
        else:
            np.logical_not(white[part], out=solid[1:-1])
        first = solid[1:-1] & ~solid[:-2]
        last = solid[1:-1] & ~solid[2:]
        inner = cuts[(cuts > lo) & (cuts < hi)] - lo  # a text begins: a word before it ends there
        glued = inner[solid[inner] & solid[inner + 1]]
        first[glued] = True
        last[glued - 1] = True
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _POWER if len(part) <= PIECE else [_powers(_BASE, len(part) + 1), _powers(pow(_BASE, -1, 1 << 64), len(part) + 1)]
        with np.errstate(over="ignore"):
            values, run = (x[: len(part) + 1] for x in (room if len(part) <= PIECE else np.empty((2, len(part) + 1), np.uint64)))
            run[0] = 0
            values = _BYTE.take(part, mode="clip", out=values[1:])
            values *= up[: len(part)]
            np.cumsum(values, out=run[1:])
            hashes.append(mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)))
        starts.append(a + lo)
        lo = hi
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)
