"""Recursive operators over recordings of any length: a key's samples are cut into blocks, and only the state goes from block to block.

A time-invariant linear recursion takes three steps. Each block answers alone from a state of nothing; what it leaves behind,
with its length, is its transition. Transitions are composed by an associative scan: FAN blocks at a time into one longer
transition, until a key has few; the states that enter are handed down again. Then every block runs from the state that enters
it. All blocks of a key run at once, in both passes.

Other recursions (weights that learn, samples that are thrown out) carry their state in sequence: block k of every key runs
in one job from the states that block k - 1 left in the shared folder, so a lost executor costs one block of its keys.

No task holds more than one block of a key. Blocks hold at most `size` samples of a key in order of (trial, samp); samp counts up
by one inside a trial.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import cut, shared_dir, ship

SIZE, FAN, STRIDE = 1 << 15, 1024, 64
#: What a step gives for each sample.
ROW = "_r struct<trial:bigint,samp:bigint,x:array<double>>"


class Linear:
    """s' = a s + b u, y = c s + d u for each channel on its own; s is (states, channels)."""

    def __init__(self, a, b, c, d: float):
        self.a, self.b, self.c, self.d = np.atleast_2d(np.array(a, float)), np.array(b, float), np.array(c, float), float(d)
        k = len(self.b)
        power, self.seen, self.hit = np.eye(k), np.zeros((STRIDE, k)), np.zeros((k, STRIDE))
        pulse = np.zeros(STRIDE)
        for t in range(STRIDE):  # what a state, and an input, do within a stride
            self.seen[t] = self.c @ power
            self.hit[:, STRIDE - 1 - t] = power @ self.b
            pulse[t] = self.d if t == 0 else self.seen[t - 1] @ self.b
            power = self.a @ power
        lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)
        self.answer, self.whole = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0), power

    @classmethod
    def sections(cls, sos: np.ndarray) -> Linear:
        """A cascade of second-order sections (b0 b1 b2 1 a1 a2)."""
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, _, a1, a2 in sos:
            f = np.array([b1 - a1 * b0, b2 - a2 * b0])  # the new states see the output of the sections before
            a = np.block([[a, np.zeros((len(a), 2))], [np.outer(f, c), np.array([[-a1, 1.0], [-a2, 0.0]])]])
            b, c, d = np.concatenate([b, f * d]), np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
        return cls(a, b, c, d)

    @classmethod
    def average(cls, alpha: float) -> Linear:
        """y = (1 - alpha) y + alpha u."""
        return cls([[1 - alpha]], [alpha], [1 - alpha], alpha)

    def steady(self, u: np.ndarray) -> np.ndarray:
        """The state after an input (channels) stood for ever."""
        return np.outer(np.linalg.solve(np.eye(len(self.a)) - self.a, self.b), u)

    def after(self, n: int, s: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n) @ s

    def run(self, u: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output for u (samples, channels), and the state after it; a stride of samples at a time."""
        y = np.empty_like(u)
        for k in range(0, len(u) // STRIDE * STRIDE, STRIDE):
            part = u[k : k + STRIDE]
            y[k : k + STRIDE] = self.seen @ s + self.answer @ part
            s = self.whole @ s + self.hit @ part
        for t in range(len(u) // STRIDE * STRIDE, len(u)):
            y[t] = self.c @ s + self.d * u[t]
            s = self.a @ s + np.outer(self.b, u[t])
        return y, s


# --- blocks


def to_blocks(df: DataFrame, keys: list[str], size: int | None = SIZE, trial: str | None = None, order: str = "samp", x: str = "x") -> DataFrame:
    """keys, block, rows (trial, samp, x in order): at most `size` samples of a key a row (None: all of them)."""
    t = F.col(trial) if trial else F.lit(0)
    if trial:
        trials = df.groupBy(*keys, trial).agg(F.min(order).alias("_first"), (F.max(order) - F.min(order) + 1).alias("_n"))
        w = Window.partitionBy(*keys).orderBy(trial)
        trials = trials.withColumn("_off", F.sum("_n").over(w) - F.col("_n") - F.col("_first")).drop("_n", "_first")  # a row a trial
        df = df.join(trials, [*keys, trial])
    at = F.col(order) + (F.col("_off") if trial else 0)
    row = F.struct(t.cast("bigint").alias("trial"), F.col(order).cast("bigint").alias("samp"), F.col(x).cast("array<double>").alias("x"))
    return df.select(*keys, (F.floor(at / size) if size else F.lit(0)).cast("bigint").alias("block"), row.alias("_r")).groupBy(*keys, "block").agg(F.sort_array(F.collect_list("_r")).alias("rows"))


def _opened(rows: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trial, samp and x (samples, channels) of block k of a batch."""
    a = rows[k].values
    return a.field(0).to_numpy(zero_copy_only=False), a.field(1).to_numpy(zero_copy_only=False), a.field(2).flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _packed(trial: np.ndarray, samp: np.ndarray, x: np.ndarray) -> pa.StructArray:
    at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.StructArray.from_arrays([pa.array(trial), pa.array(samp), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel()))], names=["trial", "samp", "x"])


def _map(df: DataFrame, keys: list[str], more: str, fn: Callable[[tuple, np.ndarray | None], dict]) -> DataFrame:
    """fn of ((trial, samp, x), state or None) for each block: a dict of the columns `more` (a StructArray is a row a sample)."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "block"]), more])
    has_state = "state" in df.columns
    df = df.select(*keys, "block", "rows", *(["state"] if has_state else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.column(b.num_columns - 1)[i].as_py() if has_state else None
                got = fn(_opened(b.column(len(keys) + 1), i), None if s is None else np.array(s))
                lists = {n: v if isinstance(v, pa.Array) else pa.array([v]) for n, v in got.items()}
                own = [pa.repeat(b.column(k)[i], len(next(iter(lists.values())))) for k in range(len(keys) + 1)]
                yield pa.RecordBatch.from_arrays([*own, *lists.values()], names=[*keys, "block", *lists])

    return df.mapInArrow(run, schema)


# --- linear recursions


def _scan(ends: DataFrame, keys: list[str], after: Callable[[int, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> DataFrame:
    """keys, block, state that enters each block, from ends (keys, block, n, left, first): what the block leaves of nothing, and the state
    to begin with where it is a key's first."""
    ship(ends.sparkSession)
    kinds = dict(ends.dtypes)
    gs = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def step(s, n, left):
        return after(int(n), s) + np.array(left).reshape(s.shape)

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        s = np.array(f["state"].iloc[0] if "state" in f and f["state"].iloc[0] is not None else f["first"].iloc[0]).reshape(shape[0], -1)
        states = []
        for n, left in zip(f["n"], f["left"], strict=True):
            states.append(s.ravel().tolist())
            s = step(s, n, left)
        return f[[*keys, "block"]].assign(state=states)

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        s = np.zeros((shape[0], len(f["left"].iloc[0]) // shape[0]))
        for n, left in zip(f["n"], f["left"], strict=True):
            s = step(s, n, left)
        top = f.iloc[0]
        return pd.DataFrame({**{k: [top[k]] for k in [*keys, "_up"]}, "n": [int(f["n"].sum())], "left": [s.ravel().tolist()], "first": [top["first"]]})

    out = f"{gs}, block bigint, state array<double>"
    most = ends.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FAN:
        return ends.groupBy(*keys).applyInPandas(walk, out)
    up = ends.withColumn("_up", F.floor(F.col("block") / FAN).cast("bigint"))
    longer = up.groupBy(*keys, "_up").applyInPandas(join, f"{gs}, _up bigint, n bigint, left array<double>, first array<double>")
    tops = _scan(cut(longer.withColumnRenamed("_up", "block"), "ends"), keys, after, shape).withColumnRenamed("block", "_up")
    return up.join(tops, [*keys, "_up"]).groupBy(*keys, "_up").applyInPandas(walk, out)


def linear_blocks(df: DataFrame, keys: list[str], systems: list[Linear], feed: Callable = lambda x: x, first: Callable | None = None, out: Callable | None = None, trial: str | None = None, size: int = SIZE) -> DataFrame:
    """df with x replaced by out(x, outputs of the systems for feed(x)); `first` gives a system's state before a key's first input (default: as if that
    input had stood for ever)."""
    first = first or (lambda system, u: system.steady(u))
    out = out or (lambda x, ys: np.concatenate(ys, axis=1))
    b = cut(to_blocks(df, keys, size, trial), "blocks")
    edges = np.cumsum([0, *(len(s.b) for s in systems)])

    def ends(rows, _):
        u = feed(rows[2])
        left = [s.run(u, np.zeros((len(s.b), u.shape[1])))[1] for s in systems]
        return {"n": len(u), "left": np.concatenate(left).ravel().tolist(), "first": np.concatenate([first(s, u[0]) for s in systems]).ravel().tolist()}

    def after(n, s):
        return np.concatenate([x.after(n, s[i:j]) for x, i, j in zip(systems, edges, edges[1:], strict=False)])

    def answer(rows, state):
        u = feed(rows[2])
        s = state.reshape(edges[-1], -1)
        ys = [x.run(u, s[i:j])[0] for x, i, j in zip(systems, edges, edges[1:], strict=False)]
        return {"_r": _packed(rows[0], rows[1], out(rows[2], ys))}

    def alone(rows, _):
        return answer(rows, np.concatenate([first(x, feed(rows[2][:1])[0]) for x in systems]))

    if not b.where("block <> 0").head(1):  # every key is one block: nothing goes from block to block
        return _rows(_map(b, keys, ROW, alone), df, keys, trial)
    states = _scan(cut(_map(b, keys, "n bigint, left array<double>, first array<double>", ends), "ends"), keys, after, (int(edges[-1]),))
    return _rows(_map(b.join(cut(states, "states"), [*keys, "block"]), keys, ROW, answer), df, keys, trial)


def _rows(d: DataFrame, like: DataFrame, keys: list[str], trial: str | None) -> DataFrame:
    kinds = dict(like.dtypes)
    d = d.select(*keys, *([F.col("_r.trial").cast(kinds[trial]).alias(trial)] if trial else []), F.col("_r.samp").cast(kinds["samp"]).alias("samp"), F.col("_r.x").alias("x"))
    rest = [c for c in like.columns if c not in d.columns]
    if rest:
        on = [*keys, *([trial] if trial else []), "samp"]
        d = d.join(like.select(*on, *rest), on)
    return d.select(*like.columns)


# --- recursions in sequence


def in_sequence(df: DataFrame, keys: list[str], fn: Callable[[tuple, np.ndarray | None], tuple[np.ndarray, np.ndarray]], trial: str | None = None, size: int = SIZE) -> DataFrame:
    """df with x replaced: fn of ((trial, samp, x) of a block, the state that the block before left or None) gives the new x and a flat state. Block k of all keys
    is one job; its rows and states are files in the shared folder."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sequence-{uuid.uuid4().hex}"
    b = to_blocks(df, keys, size, trial)
    kinds = dict(b.dtypes)
    b.withColumn("_k", F.col("block")).write.partitionBy("_k").parquet(f"{at}/blocks")
    own = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, block bigint"
    ks = sorted(r[0] for r in spark.read.schema(f"{own}, _k bigint").option("basePath", f"{at}/blocks").parquet(f"{at}/blocks").select("_k").distinct().collect())  # as many as the longest key has blocks
    done = f"{own}, _r array<{kinds['rows'][6:-1]}>, state array<double>"

    def block(rows, state):
        x, state = fn(rows, state)
        packed = _packed(rows[0], rows[1], x)
        return {"_r": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed), "state": pa.array([np.asarray(state, float).ravel().tolist()], pa.list_(pa.float64()))}

    for i, k in enumerate(ks):
        part = spark.read.schema(f"{own}, rows {kinds['rows']}").parquet(f"{at}/blocks/_k={k}")
        if i:
            before = spark.read.schema(done).parquet(f"{at}/done/_k={ks[i - 1]}").select(*keys, "state")
            part = part.join(before, keys, "left")
        else:
            part = part.withColumn("state", F.lit(None).cast("array<double>"))
        _map(part, keys, f"_r array<{kinds['rows'][6:-1]}>, state array<double>", block).write.parquet(f"{at}/done/_k={k}")
    if not ks:
        return df.limit(0)
    d = spark.read.schema(done).option("recursiveFileLookup", "true").parquet(f"{at}/done")
    return _rows(d.select(*keys, F.explode("_r").alias("_r")), df, keys, trial)
