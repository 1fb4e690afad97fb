"""Summary statistics: lagged covariances and event-related responses. Signals are long: keys, samp, ch, v; events are
keys, samp, obj, evt, v. All sums are additive over sessions, trials and folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cov_xx(signal: DataFrame, groups: list[str], x: str = "x", centre: bool = False, unit: bool = False) -> DataFrame:
    """groups, d1, d2, v of a signal with an array per row: each partition sums x x' itself, so only d * d rows a group and
    task are shuffled."""
    from pulsegrid.shared import ship

    ship(signal.sparkSession)
    schema = ", ".join(f"{g} {dict(signal.dtypes)[g]}" for g in groups)
    schema += ", " * bool(groups) + "d1 int, d2 int, v double, s1 double, s2 double, n bigint"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for f in frames:
            for g, part in f.groupby(groups) if groups else [((), f)]:
                a = np.array(part[x].tolist(), dtype=float)
                got = sums.setdefault(g if isinstance(g, tuple) else (g,), [0.0, 0.0, 0])
                got[0], got[1], got[2] = got[0] + a.T @ a, got[1] + a.sum(0), got[2] + len(a)
        for g, (c, s, n) in sums.items():
            d1, d2 = np.indices(c.shape)
            yield pd.DataFrame(dict(zip(groups, g, strict=True)) | {"d1": d1.ravel().astype(np.int32), "d2": d2.ravel().astype(np.int32), "v": c.ravel(), "s1": s[d1.ravel()], "s2": s[d2.ravel()], "n": n})

    p = signal.select(*groups, x).mapInPandas(partial, schema)
    c = p.groupBy(*groups, "d1", "d2").agg(F.sum("v").alias("v"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    v = F.col("v") - F.col("s1") * F.col("s2") / F.col("n") if centre else F.col("v")
    return c.select(*groups, "d1", "d2", (v / F.col("n") if unit else v).alias("v"))


def channel_arrays(signal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, x: the channels of each sample of a long signal as one array, in their order."""
    x = signal.groupBy(*keys, "samp").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("_x"))  # the channels of one sample
    return x.select(*keys, "samp", F.transform("_x", lambda s: s["v"]).alias("x"))


def aligned_arrays(signal: DataFrame, keys: list[str], groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, samp, x; groups, chs): x holds every channel that stands anywhere in a group, in the order of chs, 0 where a sample lacks
    one. A channel is told by its number, not its place, so groups and samples with unlike channels go through one fit."""
    chs = signal.groupBy(*groups).agg(F.sort_array(F.collect_set("ch")).alias("chs"))  # a row a group, as long as a group has channels
    x = signal.groupBy(*keys, "samp").agg(F.collect_list(F.struct("ch", "v")).alias("_x"))  # the channels of one sample
    held = F.map_from_arrays(F.transform("_x", lambda s: s["ch"]), F.transform("_x", lambda s: s["v"].cast("double")))
    x = x.select(*keys, "samp", held.alias("_m")).join(chs, groups) if groups else x.select(*keys, "samp", held.alias("_m")).crossJoin(F.broadcast(chs))
    return x.select(*keys, "samp", F.transform("chs", lambda c: F.coalesce(F.col("_m")[c], F.lit(0.0))).alias("x")), chs


def window_arrays(signal: DataFrame, keys: list[str], tau: int, x: str = "x") -> DataFrame:
    """x becomes the values at samp .. samp + tau - 1 one after the other; samples without a whole window go."""
    w = Window.partitionBy(*keys).orderBy("samp")
    parts = [F.col(x) if k == 0 else F.lead(x, k).over(w) for k in range(tau)]
    return signal.withColumn(x, F.concat(*parts)).where(F.col(x).isNotNull())


def cross_sums(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """groups, i, j, v: the sum of a[i] * b[j] over rows of arrays. Each task sums its rows, so only as many rows as the matrix
    has cells are shuffled for a group and task."""
    from pulsegrid.shared import ship

    ship(df.sparkSession)
    schema = "".join(f"{g} {dict(df.dtypes)[g]}, " for g in groups) + "i int, j int, v double"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for f in frames:
            for g, part in f.groupby(groups) if groups else [((), f)]:
                g = g if isinstance(g, tuple) else (g,)
                sums[g] = sums.get(g, 0.0) + np.array(part[a].tolist(), float).T @ np.array(part[b].tolist(), float)
        for g, c in sums.items():
            i, j = np.indices(c.shape)
            yield pd.DataFrame(dict(zip(groups, g, strict=True)) | {"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": c.ravel()})

    return df.select(*groups, a, b).mapInPandas(partial, schema).groupBy(*groups, "i", "j").agg(F.sum("v").alias("v"))


def crossautocov(x: DataFrame, y: DataFrame, keys: list[str], groups: list[str], tau_x: int, tau_y: int) -> DataFrame:
    """groups, lag1, d1, lag2, d2, v: sum over t of x[t + lag1, d1] * y[t + lag2, d2] for lag1 < tau_x, lag2 < tau_y, over the t
    at which both windows are whole. x and y are keys, samp, x (array)."""
    a = window_arrays(x, keys, tau_x).select(*keys, "samp", F.col("x").alias("_a"), (F.size("x") / tau_x).cast("int").alias("_da"))
    b = window_arrays(y, keys, tau_y).select(*keys, "samp", F.col("x").alias("_b"), (F.size("x") / tau_y).cast("int").alias("_db"))
    j = a.join(b, [*keys, "samp"])
    c = cross_sums(j, [*groups, "_da", "_db"], "_a", "_b")
    lag, d = lambda i, n: F.floor(F.col(i) / F.col(n)).cast("int"), lambda i, n: F.pmod(F.col(i), F.col(n))
    return c.select(*groups, lag("i", "_da").alias("lag1"), d("i", "_da").alias("d1"), lag("j", "_db").alias("lag2"), d("j", "_db").alias("d2"), "v")


def cov_xy(signal: DataFrame, events: DataFrame, keys: list[str], groups: list[str], tau: int, offset: int = 0, centre: bool = False) -> DataFrame:
    """groups, obj, evt, lag, ch, v: sum over samples t <= last + 1 - tau of y[t] * x[t + lag], y moved by offset. Only events
    that are not 0 are spread over lags."""
    last = signal.groupBy(*keys).agg(F.max("samp").alias("_last"))
    e = events.where("v <> 0").withColumn("_t", F.col("samp") + offset).join(last, keys).where((F.col("_t") >= 0) & (F.col("_t") <= F.col("_last") + 1 - tau))
    if centre:
        mean = signal.groupBy(*groups, "ch").agg(F.avg("v").alias("_m"))
    e = e.select(*keys, "obj", "evt", F.col("v").alias("_y"), "_t", F.explode(F.sequence(F.lit(0), F.lit(tau - 1))).alias("lag")).withColumn("samp", F.col("_t") + F.col("lag"))
    j = e.join(signal.select(*keys, "samp", "ch", F.col("v").alias("_x")), [*keys, "samp"])
    if centre:
        j = j.join(mean, [*groups, "ch"]).withColumn("_x", F.col("_x") - F.col("_m"))
    return j.groupBy(*groups, "obj", "evt", "lag", "ch").agg(F.sum(F.col("_y") * F.col("_x")).alias("v"))


def cov_xy_nested(signal: DataFrame, events: DataFrame, keys: list[str], groups: list[str], tau: int) -> DataFrame:
    """groups, obj, evt, lag, ch, edge, v: cov_xy for every response length up to tau from one pass. edge: the samples from an event to the end of
    its trial, at most tau. The sums for a length are those of lag < length and edge >= length."""
    last = signal.groupBy(*keys).agg(F.max("samp").alias("_last"))
    e = events.where("v <> 0").join(last, keys).withColumn("edge", F.least(F.col("_last") + 1 - F.col("samp"), F.lit(tau)).cast("int")).where("edge > 0 and samp >= 0")
    e = e.select(*keys, "obj", "evt", "edge", F.col("v").alias("_y"), F.col("samp").alias("_t"), F.explode(F.sequence(F.lit(0), F.col("edge") - 1)).alias("lag")).withColumn("samp", F.col("_t") + F.col("lag"))
    j = e.join(signal.select(*keys, "samp", "ch", F.col("v").alias("_x")), [*keys, "samp"])
    return j.groupBy(*groups, "obj", "evt", "lag", "ch", "edge").agg(F.sum(F.col("_y") * F.col("_x")).alias("v"))


def cov_yy(events: DataFrame, keys: list[str], groups: list[str], tau: int, cross: bool = False) -> DataFrame:
    """groups, obj (cross: obj, obj2), evt1, evt2, lag, v: sum of y[t + lag, evt1] * y[t, evt2]. Event rows that are not 0
    meet by buckets of tau samples."""
    e = events.where("v <> 0")
    a = e.select(*keys, F.col("samp").alias("_s1"), F.col("obj"), F.col("evt").alias("evt1"), F.col("v").alias("_v1"), F.floor(F.col("samp") / tau).alias("_b"))
    b = e.select(*keys, F.col("samp").alias("_s2"), F.col("obj").alias("obj2"), F.col("evt").alias("evt2"), F.col("v").alias("_v2"), F.explode(F.array(F.floor(F.col("samp") / tau), F.floor(F.col("samp") / tau) + 1)).alias("_b"))
    j = a.join(b, [*keys, "_b"]).withColumn("lag", F.col("_s1") - F.col("_s2")).where((F.col("lag") >= 0) & (F.col("lag") < tau))
    if not cross:
        j = j.where(F.col("obj") == F.col("obj2"))
    return j.groupBy(*groups, "obj", *(["obj2"] if cross else []), "evt1", "evt2", "lag").agg(F.sum(F.col("_v1") * F.col("_v2")).alias("v"))


def toeplitz_expand(lagged: DataFrame, groups: list[str], tau: int) -> DataFrame:
    """groups, evt1, i, evt2, j, v: the full block matrix of lag-compressed (evt1, evt2, lag); a negative lag takes the transpose."""
    up = lagged.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tau - 1)))).withColumn("j", F.col("i") + F.col("lag")).where(F.col("j") < tau)
    low = up.where("lag > 0").select(*groups, F.col("evt2").alias("evt1"), F.col("j").alias("i"), F.col("evt1").alias("evt2"), F.col("i").alias("j"), "v")
    return up.select(*groups, "evt1", "i", "evt2", "j", "v").union(low)


def autocov_xx(signal: DataFrame, keys: list[str], groups: list[str], tau: int) -> DataFrame:
    """groups, lag, d1, d2, v: sum over t of x[t + lag, d1] * x[t, d2]; 0 for lags that no trial reaches. A row a sample: the samples of all lags one after the
    other, 0 behind the end of the trial."""
    x = channel_arrays(signal, keys)
    w = Window.partitionBy(*keys).orderBy("samp")
    none = F.transform("x", lambda v: F.lit(0.0))
    ahead = F.concat(F.col("x"), *[F.coalesce(F.lead("x", k).over(w), none) for k in range(1, tau)])
    j = x.select(*groups, F.size("x").alias("_d"), ahead.alias("_a"), F.col("x").alias("_b"))
    c = cross_sums(j, [*groups, "_d"], "_a", "_b")
    return c.select(*groups, F.floor(F.col("i") / F.col("_d")).cast("int").alias("lag"), F.pmod("i", "_d").alias("d1"), F.col("j").alias("d2"), "v")


def crosscov_lags(x: DataFrame, y: DataFrame, keys: list[str], groups: list[str], back: int, ahead: int) -> DataFrame:
    """groups, lag, ch, obj, v: sum over t of x[t + lag, ch] * y[t, obj] for lags -(back - 1) .. ahead - 1."""
    e = y.where("v <> 0").select(*keys, F.col("samp").alias("_t"), "obj", F.col("v").alias("_y"), F.explode(F.sequence(F.lit(1 - back), F.lit(ahead - 1))).alias("lag")).withColumn("samp", F.col("_t") + F.col("lag"))
    j = e.join(x.select(*keys, "samp", "ch", F.col("v").alias("_x")), [*keys, "samp"])
    return j.groupBy(*groups, "lag", "ch", "obj").agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))


def merge_stats(old: DataFrame, new: DataFrame, by: list[str], decay: float = 1.0) -> DataFrame:
    """old * decay + new of additive statistics."""
    return old.select(*by, (F.col("v") * decay).alias("v")).unionByName(new.select(*by, "v")).groupBy(*by).agg(F.sum("v").alias("v"))


def erp(signal: DataFrame, events: DataFrame, keys: list[str], groups: list[str], tau: int, baseline: int = 0) -> DataFrame:
    """groups, evt, lag, ch, v, n: mean response and epoch count; baseline: subtract the mean of the first lags of each epoch."""
    e = events.where("v <> 0").select(*keys, F.col("samp").alias("_t"), "evt", F.explode(F.sequence(F.lit(0), F.lit(tau - 1))).alias("lag")).withColumn("samp", F.col("_t") + F.col("lag"))
    j = e.join(signal.select(*keys, "samp", "ch", "v"), [*keys, "samp"])
    if baseline:
        b = j.where(F.col("lag") < baseline).groupBy(*keys, "_t", "evt", "ch").agg(F.avg("v").alias("_b"))
        j = j.join(b, [*keys, "_t", "evt", "ch"]).withColumn("v", F.col("v") - F.col("_b"))
    return j.groupBy(*groups, "evt", "lag", "ch").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def erp_components(mean: DataFrame, groups: list[str], rank: int = 3) -> DataFrame:
    """groups, evt, k, kind (time or space), idx, v: the leading parts of each response (lags x channels), the sign chosen so
    that the largest space weight is positive; the strength is on the time side."""
    from pulsegrid.shared import ship

    ship(mean.sparkSession)
    kinds = dict(mean.dtypes)

    def parts(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot(index="lag", columns="ch", values="v").fillna(0.0)
        u, s, vt = np.linalg.svd(m.to_numpy(), full_matrices=False)
        out = []
        for k in range(min(rank, len(s))):
            sign = np.sign(vt[k][np.argmax(np.abs(vt[k]))]) or 1.0
            out += [(k, "time", int(i), float(x)) for i, x in zip(m.index, u[:, k] * s[k] * sign, strict=True)]
            out += [(k, "space", int(i), float(x)) for i, x in zip(m.columns, vt[k] * sign, strict=True)]
        d = pd.DataFrame(out, columns=["k", "kind", "idx", "v"])
        for i, c in enumerate([*groups, "evt"]):
            d.insert(i, c, f[c].iloc[0])
        return d

    schema = ", ".join(f"{g} {kinds[g]}" for g in [*groups, "evt"]) + ", k int, kind string, idx int, v double"
    return mean.groupBy(*groups, "evt").applyInPandas(parts, schema)


def event_locked_matrix(trace: DataFrame, events: DataFrame, keys: list[str], tau: int) -> tuple[DataFrame, DataFrame]:
    """(epochs: keys, epoch, lag, v of the true target's events; spread: lag, median, mad)."""
    t = events.where("obj = 0 and v <> 0").select(*keys, F.col("samp").alias("epoch"), F.explode(F.sequence(F.lit(0), F.lit(tau - 1))).alias("lag")).withColumn("samp", F.col("epoch") + F.col("lag"))
    e = t.join(trace.select(*keys, "samp", "v"), [*keys, "samp"]).drop("samp")
    m = e.groupBy("lag").agg(F.percentile("v", F.lit(0.5)).alias("median"))
    return e, e.join(m, "lag").groupBy("lag").agg(F.first("median").alias("median"), F.percentile(F.abs(F.col("v") - F.col("median")), F.lit(0.5)).alias("mad"))
