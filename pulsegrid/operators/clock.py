"""Clock and time-stamp operators. Keys are column names; order columns must be unique within a key."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators.blocks import SIZE, in_sequence
from pulsegrid.shared import cut


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def unwrap_ts(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", span: int | None = None, out: str = "unwrapped") -> DataFrame:
    """Add span after every backward jump of more than half of it. Default span: the least power of two that is no less
    than the key's largest time."""
    w = _w(keys, order)
    if span is None:
        df = df.withColumn("_span", F.pow(F.lit(2.0), F.ceil(F.log2(F.max(ts).over(Window.partitionBy(*keys))))).cast("long"))
    else:
        df = df.withColumn("_span", F.lit(span).cast("long"))
    jump = F.when((F.lag(ts).over(w) - F.col(ts)) * 2 > F.col("_span"), F.col("_span")).otherwise(0)
    df = df.withColumn("_jump", jump)
    return df.withColumn(out, F.col(ts) + F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump", "_span")


def wrap_ts(df: DataFrame, ts: str = "ts", bits: int = 24, out: str = "wrapped") -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(ts), F.lit(1 << bits)))


def use_server_ts(df: DataFrame, ts: str = "cts", server: str = "sts", keep: str = "raw_ts") -> DataFrame:
    return df.withColumn(keep, F.col(ts)).withColumn(ts, F.col(server))


def robust_clock_fit(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 4, limit: float = 3.0) -> DataFrame:
    """keys, slope, intercept, n, x0, y0 of y - y0 = slope * (x - x0) + intercept. Rows with -1 are left out; after each
    fit rows whose absolute error is over `limit` times the mean one are dropped before the next."""
    good = df.where((F.col(x) != -1) & (F.col(y) != -1))
    base = cut(good.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0")), "fit")
    rows = cut(good.join(base, keys).select(*keys, (F.col(x) - F.col("x0")).cast("double").alias("x"), (F.col(y) - F.col("y0")).cast("double").alias("y")), "points")
    # the points are written once; a round reads them with the lines and limits of the rounds before, a row a key
    line = "array<struct<slope:double,intercept:double,most:double>>"
    past, fit = base.select(*keys, F.array().cast(line).alias("past")), None
    off = lambda h: F.abs(F.col("y") - h["slope"] * F.col("x") - h["intercept"])
    for k in range(rounds):
        kept = rows.join(past, keys).where(F.forall("past", lambda h: off(h) <= h["most"]))
        fit = kept.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n"))
        if k < rounds - 1:
            fit = cut(fit, "fit")
            err = F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
            mean = kept.join(fit, keys).groupBy(*keys).agg(F.avg(err).alias("_e"))
            now = F.array(F.struct("slope", "intercept", (limit * F.col("_e")).alias("most"))).cast(line)
            past = cut(past.join(fit, keys).join(mean, keys).select(*keys, F.concat("past", now).alias("past")), "fit")
    return fit.join(base, keys)


def apply_clock(df: DataFrame, fit: DataFrame, keys: list[str], x: str, out: str = "aligned") -> DataFrame:
    j = df.join(fit.select(*keys, "slope", "intercept", "x0", "y0"), keys, "left")
    return j.withColumn(out, F.coalesce(F.col("y0") + F.col("slope") * (F.col(x) - F.col("x0")) + F.col("intercept"), F.col(x).cast("double"))).drop("slope", "intercept", "x0", "y0")


def clock_from_channel(packets: DataFrame, keys: list[str], channel: int, rts: str = "rts") -> DataFrame:
    """Fit of received time on the time-stamp channel of each packet's last sample. packets: samples array<array>."""
    x = F.element_at(F.element_at("samples", -1), channel + 1)
    return robust_clock_fit(packets.withColumn("_x", x), keys, "_x", rts)


def windowed_offset(df: DataFrame, keys: list[str], x: str, y: str, sync, tie: str, window: int = 60_000, how: str = "min") -> DataFrame:
    """offset: least (or largest) y - x of sync messages in the trailing window (x - window, x], carried to all messages.

    Time is cut into stretches one window long, so a trailing window is the rest of one stretch and the beginning of the next: one running value
    backwards over each stretch and one forwards, and no frame is looked through row by row."""
    best, pick = (F.min, F.least) if how == "min" else (F.max, F.greatest)
    d = df.withColumn("_sync", sync).withColumn("_diff", F.when(F.col("_sync"), F.col(y) - F.col(x))).withColumn("_at", F.col(x))
    d = d.withColumn("_part", F.col("_at") - F.pmod(F.col("_at"), F.lit(window)))
    stretch = Window.partitionBy(*keys, "_part")
    d = d.withColumn("_fore", best("_diff").over(stretch.orderBy("_at"))).withColumn("_back", best("_diff").over(stretch.orderBy(F.col("_at").desc())))
    # what the stretch before holds after x - window: its backward values stand among the rows of the next stretch as marks one window later
    row, mark = d.withColumn("_mark", F.lit(1)), d.where("_diff is not null").select(*keys, (F.col("_at") + window).alias("_at"), (F.col("_part") + window).alias("_part"), F.col("_back"), F.lit(0).alias("_mark"))
    both = row.drop("_back").unionByName(mark, allowMissingColumns=True)
    # the first mark later than x: what stands there is the best of all after x - window
    after = stretch.orderBy(F.col("_at").desc(), F.col("_mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_rest", F.last("_back", ignorenulls=True).over(after)).where("_mark = 1")
    d = both.withColumn("_best", F.when(F.col("_sync"), pick("_fore", "_rest")))
    carry = _w(keys, [x, tie]).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("offset", F.last("_best", ignorenulls=True).over(carry)).select(*df.columns, "offset")


def running_min_offset(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, freeze: int = 100) -> DataFrame:
    d = df.withColumn("_n", F.row_number().over(_w(keys, order))).withColumn("_d", F.when(F.col("_n") <= freeze, F.col(y) - F.col(x)))
    return d.withColumn("offset", F.min("_d").over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_n", "_d")


def interpolate_sample_ts(packets: DataFrame, keys: list[str], order: list[str], fs: float | None = None) -> DataFrame:
    """One row a sample of packets (ts of the last sample, nsamp): times spread from the previous packet's time; where it
    did not advance, steps of 1000 / fs backwards, or the same time when fs is unknown."""
    p = packets.withColumn("_prev", F.lag("ts").over(_w(keys, order)))
    s = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("nsamp").cast("int"))))
    step = 1000.0 / fs if fs else 0.0
    t = F.when(F.col("ts") > F.col("_prev"), F.col("_prev") + (F.col("ts") - F.col("_prev")) * F.col("k") / F.col("nsamp")).otherwise(F.col("ts") - (F.col("nsamp") - F.col("k")) * F.lit(step))
    return s.withColumn("sample_ts", t.cast("double")).drop("_prev")


def estimate_fs(samples: DataFrame, keys: list[str], order: list[str], stride: int = 1000) -> DataFrame:
    """keys, fs: 1000 times the stride over the median time of a stride (ms)."""
    w = _w(keys, order)
    s = samples.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % stride == 0)
    s = s.withColumn("_d", F.col("ts") - F.lag("ts").over(Window.partitionBy(*keys).orderBy("_n")))
    return s.groupBy(*keys).agg((1000.0 * stride / F.percentile("_d", F.lit(0.5))).alias("fs"))


def timestamp_jitter(packets: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """keys, centre, scale of the error against a clock of constant rate through the first and last time."""
    w = _w(keys, order)
    run = F.sum("nsamp").over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = packets.withColumn("_run", run)
    ends = p.groupBy(*keys).agg(F.min_by(ts, "_run").alias("t0"), F.max_by(ts, "_run").alias("t1"), F.min("_run").alias("r0"), F.max("_run").alias("r1"))
    e = p.join(ends, keys).withColumn("_err", F.col(ts) - (F.col("t0") + (F.col("t1") - F.col("t0")) * (F.col("_run") - F.col("r0")) / F.greatest(F.col("r1") - F.col("r0"), F.lit(1))))
    c = e.groupBy(*keys).agg(F.percentile("_err", F.lit(0.5)).alias("centre"))
    return e.join(c, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), F.percentile(F.abs(F.col("_err") - F.col("centre")), F.lit(0.75)).alias("scale"))


def last_intervals(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", last: int = 120) -> DataFrame:
    w = _w(keys, order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    d = df.withColumn("interval", F.col(ts) - F.lag(ts).over(w)).withColumn("_r", F.row_number().over(back))
    return d.where((F.col("_r") <= last) & F.col("interval").isNotNull()).select(*keys, "interval")


def interval_stats(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", last: int = 120) -> DataFrame:
    d = last_intervals(df, keys, order, ts, last)
    i = F.col("interval")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(i).alias("mean"), F.percentile(i, F.lit(0.5)).alias("median"), F.stddev_samp(i).alias("sd"), F.min(i).alias("least"), F.max(i).alias("most"))


def interval_histogram(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts", last: int = 120) -> DataFrame:
    """keys, bin (0..13), n: 15 edges from the least, 0.6 of the range over 15 apart; what lies above is not counted."""
    d = last_intervals(df, keys, order, ts, last)
    w = Window.partitionBy(*keys)
    width = 0.6 * (F.max("interval").over(w) - F.min("interval").over(w)) / 15
    d = d.withColumn("_w", width).withColumn("_x", F.col("interval") - F.min("interval").over(w))
    b = F.when(F.col("_w") > 0, F.least(F.floor(F.col("_x") / F.col("_w")), F.when(F.col("_x") <= 14 * F.col("_w"), 13).otherwise(99))).otherwise(0)
    return d.withColumn("bin", b.cast("int")).where("bin < 14").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


# --- trackers: a line that follows its points, block by block of each client


def _tracked(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, make, size: int) -> DataFrame:
    """df + aligned: y as told by a tracker that sees (x, y) in order and answers for each x. make(state or None) gives a tracker with step(x, y)
    and flat(); only that state goes from block to block of a client."""
    d = cut(df.withColumn("_pos", (F.row_number().over(_w(keys, order)) - 1).cast("bigint")), "points")

    def fn(rows, state):
        t = make(state)
        return np.array([[t.step(a, b)] for a, b in rows[2].tolist()]), t.flat()

    points = d.select(*keys, F.col("_pos").alias("samp"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("x"))
    got = in_sequence(points, keys, fn, size=size)
    return d.join(got.select(*keys, F.col("samp").alias("_pos"), F.get("x", F.lit(0)).alias("aligned")), [*keys, "_pos"]).select(*df.columns, "aligned")


class ExpWeightedLine:
    """A line through weighted sums that halve every `halflife` points; the slope is the mean of both regressions' slopes.
    A point far from the line (over `cut` times the mean error) counts for the error only. State: points so far, origin, mean error,
    and the sums of 1, x, y, x x, y y, x y."""

    def __init__(self, halflife: float = 100.0, cut: float = 3.0, warm: int = 5, state: np.ndarray | None = None):
        self.keep, self.cut, self.warm = 0.5 ** (1 / halflife), cut, warm
        self.n, self.x0, self.y0, self.err = (0.0, 0.0, 0.0, 0.0) if state is None else state[:4]
        self.sums = np.zeros(6) if state is None else state[4:]

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n, self.x0, self.y0, self.err], self.sums])

    def line(self) -> tuple[float, float]:
        mx, my, xx, yy, xy = (self.sums[1:] / self.sums[0]).tolist()
        vxx, vyy, vxy = xx - mx * mx, yy - my * my, xy - mx * my
        slope = (vxy / vxx + vyy / vxy) / 2 if vxx > 1e-12 and abs(vxy) > 1e-12 else 1.0
        return slope, my - slope * mx

    def step(self, x: float, y: float) -> float:
        if not self.n:
            self.x0, self.y0 = x, y
        x, y = x - self.x0, y - self.y0
        out = y
        if self.n:
            slope, off = self.line()
            out = slope * x + off
        e = abs(y - out)
        if self.n < self.warm or e <= self.cut * max(self.err, 1e-9):
            self.sums = self.keep * self.sums + np.array([1.0, x, y, x * x, y * y, x * y])
        self.err = e if not self.n else self.keep * self.err + (1 - self.keep) * e
        self.n += 1
        slope, off = self.line()
        return self.y0 + slope * x + off


class LowerBoundLine:
    """A line along the lower edge of the newest `window` points.

    Fewer than `warm` points: the slope is the median slope between neighbours (`slope` until there are three), and the line
    goes through the newest point. Then rounds of weighted least squares that begin at the line before: an error over
    soft[0] counts soft[0] / error (under -soft[1] likewise), one further than hard[0] times the mean deviation over the mean error not at all
    (hard[1]: under it); None leaves a side alone. When the median error of the newest `last` points is more than `jump` deviations off the median of the
    others, the clock has stepped: all points are forgotten, the line stays until new ones move it.

    State: whether it has begun, slope, offset, and the points of the window."""

    def __init__(self, window: int = 200, soft=(0.1, None), hard=(1.0, None), last: int = 10, jump: float = 2.0, slope: float = 1.0, warm: int = 10, rounds: int = 3, state: np.ndarray | None = None):
        self.window, self.soft, self.hard, self.last, self.jump, self.warm, self.rounds = window, soft, hard, last, jump, warm, rounds
        self.begun, self.slope, self.offset = (0.0, slope, 0.0) if state is None else state[:3].tolist()
        self.points = np.zeros((0, 2)) if state is None else state[3:].reshape(-1, 2)
        self.room, self.end = np.zeros((0, 2)), 0

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.begun, self.slope, self.offset], self.points.ravel()])

    def push(self, x: float, y: float) -> np.ndarray:
        """The points of the window with a new one: a view that moves along a table, which begins anew when it is full."""
        kept = self.points[len(self.points) + 1 - self.window if len(self.points) >= self.window else 0 :]
        if self.end >= len(self.room):
            self.room, self.end = np.zeros((8 * (len(kept) + 8), 2)), len(kept)
            self.room[: self.end] = kept
        self.room[self.end] = x, y
        self.end += 1
        self.points = self.room[self.end - len(kept) - 1 : self.end]
        return self.points

    def weights(self, err: np.ndarray) -> np.ndarray:
        w, off = np.ones(len(err)), err - _mean(err)
        spread = _mean(np.abs(off))
        for side, soft, hard in zip((1, -1), self.soft, self.hard, strict=True):
            if soft is not None:
                e = err if side > 0 else -err
                if soft > 0 and side > 0:
                    w = soft / np.fmax(e, soft)
                else:
                    np.putmask(w, e > soft, soft / np.maximum(e, soft))
            if hard is not None:
                np.putmask(w, (off if side > 0 else -off) > hard * spread, 0.0)
        return w

    def step(self, x: float, y: float) -> float:
        points = self.push(x, y)
        n = len(points)
        if not self.begun:
            self.begun, self.offset = 1.0, y - self.slope * x
            return y
        if n < self.warm:
            dx, dy = np.diff(points, axis=0).T
            if n > 2 and dx.any():
                self.slope = float(np.median(dy[dx != 0] / dx[dx != 0]))
            self.offset = y - self.slope * x
            return y
        mid = np.array([_median(points[:, 0]), _median(points[:, 1])])
        px, py = (points - mid).T
        mid = mid.tolist()
        slope, off = self.slope, self.offset + self.slope * mid[0] - mid[1]
        for _ in range(self.rounds):
            err = py - slope * px - off
            w = self.weights(err)
            total = float(np.add.reduce(w))
            mx, my = float(w.dot(px)) / total, float(w.dot(py)) / total
            dx = px - mx
            var = float(w.dot(dx * dx))
            if var > 1e-12:
                slope = float(w.dot(dx * (py - my))) / var
            off = my - slope * mx
        self.slope, self.offset = slope, off - slope * mid[0] + mid[1]
        if n > 2 * self.last:
            old, new = err[: -self.last], _median(err[-self.last :])
            far = old - _mean(old)
            if abs(new - _median(old)) > self.jump * _mean(far * far) ** 0.5:
                self.points = self.points[:0]
        return self.slope * x + self.offset


def _mean(v: np.ndarray) -> float:
    """v.mean(), without its care for other kinds: most of the time of a step would go there."""
    return float(np.add.reduce(v)) / len(v)


def _median(v: np.ndarray) -> float:
    """np.median(v), likewise."""
    v, n = np.sort(v), len(v)
    if v[-1] != v[-1]:
        return math.nan
    return v.item(n // 2) if n % 2 else (v.item(n // 2 - 1) + v.item(n // 2)) / 2


def exp_weighted_clock(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, halflife: float = 100.0, size: int = SIZE) -> DataFrame:
    return _tracked(df, keys, order, x, y, lambda state: ExpWeightedLine(halflife, state=state), size)


def lower_bound_clock(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, window: int = 200, size: int = SIZE, **options) -> DataFrame:
    """options: those of LowerBoundLine."""
    return _tracked(df, keys, order, x, y, lambda state: LowerBoundLine(window, state=state, **options), size)
