"""Projections and cleaning of signals in DataFrame functions. x: an array per sample; long signals: ch, v."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def center_trials(signal: DataFrame, keys: list[str], first: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys, "ch")
    base = F.min_by("v", "samp").over(w) if first else F.avg("v").over(w)
    return signal.withColumn("v", F.col("v") - base)


def common_average_reference(signal: DataFrame, x: str = "x") -> DataFrame:
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    return signal.withColumn("_m", mean).withColumn(x, F.transform(x, lambda v: v - F.col("_m"))).drop("_m")


def outliers(power: DataFrame, groups: list[str], thresh: float, rounds: int = 4) -> DataFrame:
    """power (groups, item columns, p) + bad: in each round a good item over mean + thresh * deviation of the good ones goes
    bad and stays bad."""
    d = power.withColumn("bad", F.lit(False))
    w = Window.partitionBy(*groups)
    for _ in range(rounds):
        g = F.when(~F.col("bad"), F.col("p"))
        d = d.withColumn("_c", F.avg(g).over(w) + thresh * F.stddev_pop(g).over(w)).withColumn("bad", F.col("bad") | (F.col("p") > F.col("_c"))).drop("_c")
    return d


def bad_channels(signal: DataFrame, groups: list[str], thresh: float = 3.5) -> DataFrame:
    p = signal.groupBy(*groups, "ch").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("p"))
    return outliers(p, groups, thresh)


def drop_bad(signal: DataFrame, marked: DataFrame, by: list[str]) -> DataFrame:
    return signal.join(marked.where("bad").select(*by), by, "left_anti")


def bad_trials(signal: DataFrame, groups: list[str], trial: str = "trial", thresh: float = 3.5) -> DataFrame:
    p = signal.groupBy(*groups, trial).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("p"))
    return outliers(p, groups, thresh)


def zero_outliers(signal: DataFrame, groups: list[str], trial: str = "trial", thresh: float = 4.0) -> DataFrame:
    """Zero the trials of too much power, then the channels of a trial at twice the threshold."""
    t = bad_trials(signal, groups, trial, thresh).where("bad").select(*groups, trial, F.lit(True).alias("_t"))
    s = signal.join(t, [*groups, trial], "left").withColumn("v", F.when(F.col("_t"), 0.0).otherwise(F.col("v"))).drop("_t")
    p = s.groupBy(*groups, trial, "ch").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("p"))
    c = outliers(p, groups, 2 * thresh).where("bad").select(*groups, trial, "ch", F.lit(True).alias("_c"))
    return s.join(c, [*groups, trial, "ch"], "left").withColumn("v", F.when(F.col("_c"), 0.0).otherwise(F.col("v"))).drop("_c")


def robust_mean(rows: DataFrame, groups: list[str], value: str = "v", high: float = 3.0, low: float = 3.0, rounds: int = 4) -> DataFrame:
    """groups, mean, n: in each round all rows are judged anew by the mean and deviation of those that were good."""
    d = rows.withColumn("_ok", F.lit(True))
    w = Window.partitionBy(*groups)
    for _ in range(rounds):
        g = F.when(F.col("_ok"), F.col(value))
        d = d.withColumn("_m", F.avg(g).over(w)).withColumn("_s", F.stddev_pop(g).over(w))
        d = d.withColumn("_ok", (F.col(value) <= F.col("_m") + high * F.col("_s")) & (F.col(value) >= F.col("_m") - low * F.col("_s"))).drop("_m", "_s")
    return d.where("_ok").groupBy(*groups).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def decimate(signal: DataFrame, factor: float, keys: list[str], columns: list[str]) -> DataFrame:
    """Every factor-th sample, factor a multiple of one half: half places lie between their neighbours. samp counts anew."""
    twice = round(2 * factor)
    w = Window.partitionBy(*keys).orderBy("samp")
    s = signal
    for c in columns:
        s = s.withColumn(f"_n_{c}", F.lead(c).over(w))
    s = s.withColumn("_at", F.explode(F.array(2 * F.col("samp"), 2 * F.col("samp") + 1))).where(F.col("_at") % twice == 0)
    half = F.col("_at") % 2 == 1
    for c in columns:
        s = s.withColumn(c, F.when(half, (F.col(c) + F.col(f"_n_{c}")) / 2).otherwise(F.col(c)))
    return s.where(~half | F.col(f"_n_{columns[0]}").isNotNull()).withColumn("samp", (F.col("_at") / twice).cast("bigint")).drop("_at", *[f"_n_{c}" for c in columns])


def downsample_max(events: DataFrame, factor: int, by: list[str]) -> DataFrame:
    return events.groupBy(*by, F.floor(F.col("samp") / factor).alias("samp")).agg(F.max("v").alias("v"))


def fir_embed(signal: DataFrame, keys: list[str], taps: int, dilation: int = 1, x: str = "x") -> DataFrame:
    """x becomes the concatenation of x at samp, samp + dilation, ...; samples without the whole window go."""
    w = Window.partitionBy(*keys).orderBy("samp")
    parts = [F.col(x) if k == 0 else F.lead(x, k * dilation).over(w) for k in range(taps)]
    return signal.withColumn("_e", F.concat(*parts)).where("_e is not null").drop(x).withColumnRenamed("_e", x)


def zscore_targets(rows: DataFrame, groups: list[str], value: str = "v") -> DataFrame:
    w = Window.partitionBy(*groups)
    s = F.stddev_pop(value).over(w)
    return rows.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.when(s < 1e-6, 1.0).otherwise(s))


def noise_to_signal(raw: Column, pre: Column) -> Column:
    """From powers before and after cleaning: amplitude that was removed over what is left, at most 100."""
    a, b = F.sqrt(F.greatest(raw, F.lit(1e-8))), F.sqrt(F.greatest(pre, F.lit(1e-8)))
    ratio = F.greatest(F.lit(1e-6), F.abs(a - b)) / b
    return F.when((raw < 1e-6) | (b > 10 * a), 100.0).otherwise(F.least(F.lit(100.0), ratio))


def project(x: str, weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.element_at(x, i + 1) * w for i, w in enumerate(weights)])
