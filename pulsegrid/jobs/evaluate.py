"""Error against time, stopping curves, and averages over sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators import scores
from pulsegrid.shared import cut


def even_lengths(n: int, most: int = 30) -> list[int]:
    """Up to `most` lengths in even steps that end with n: the whole parts of n k / most; all lengths where there are no more."""
    return [n * k // most for k in range(1, most + 1)] if n > most else list(range(1, n + 1))


def decoding_curve(fy: DataFrame, keys: list[str], lengths: list[int] | None = None, scale: float = 1.0, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trials: keys, len, yest, perr, yerr; curve: len, err, err_est). Running sums of a prefix are those of the whole, so the
    normalisation is done once and kept at the lengths alone. Trials without a true score are left out. Without lengths they are the even_lengths of the
    longest trial that is left."""
    good = fy.where("obj = 0 and v <> 0").select(*keys).distinct()
    f = fy.join(good, keys, "left_semi")
    if dedup:
        f = scores.dedup_true_output(f, keys)
    if lengths is None:
        f = cut(f, "scores")  # read for the longest trial, and for the sums
        lengths = even_lengths((f.agg(F.max("samp")).first()[0] or 0) + 1)
    z = scores.normalize_scores(f, keys, at=[n - 1 for n in lengths])
    p = scores.target_probs(z.withColumn("len", (F.col("samp") + 1).cast("int")), [*keys, "len"], scale=scale)
    t = scores.select_output(p, [*keys, "len"]).withColumn("yerr", (F.col("yest") != 0).cast("int"))
    return t, t.groupBy("len").agg(F.avg("yerr").alias("err"), F.avg("perr").alias("err_est"))


def stop_thresholds(n: int) -> list[float]:
    high = [1 - math.exp(-0.25 + (-5 + 0.25) * k / max(1, n - 1)) for k in range(n)]
    return [high[0] * (0.2 + 0.3 * k) for k in range(3)] + high


def stopping_curve(trials: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """len, stop_thresh, stop_perr, stop_err: each trial stops at the first length whose perr is under the threshold (else at
    its last); means over trials; for each length the threshold whose mean stop is nearest."""
    th = trials.sparkSession.createDataFrame([(k, t) for k, t in enumerate(stop_thresholds(n))], "no int, thresh double")
    x = trials.join(F.broadcast(th))
    row = F.struct("len", "perr", "yerr")
    s = x.groupBy(*keys, "no", "thresh").agg(F.coalesce(F.min(F.when(F.col("perr") < F.col("thresh"), row)), F.max(row)).alias("_s"))
    m = s.groupBy("no", "thresh").agg(F.avg("_s.len").alias("stop_len"), F.avg("_s.perr").alias("stop_perr"), F.avg("_s.yerr").alias("stop_err"))
    j = trials.select("len").distinct().join(F.broadcast(m))
    best = j.groupBy("len").agg(F.min(F.struct(F.round(F.abs(F.col("len") - F.col("stop_len")), 9).alias("d"), "no", "thresh", "stop_perr", "stop_err")).alias("_b"))
    return best.select("len", F.col("_b.thresh").alias("stop_thresh"), F.col("_b.stop_perr").alias("stop_perr"), F.col("_b.stop_err").alias("stop_err"))


def curve_metrics(curve: DataFrame, stopping: DataFrame, floor: float = 0.1) -> DataFrame:
    """One row: audc, psae, ausc, ssae."""
    j = curve.join(stopping, "len")
    gap = lambda a, b: 100 * F.avg(F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(floor)))
    return j.agg((100 * F.avg("err")).alias("audc"), gap("err_est", "err").alias("psae"), (100 * F.avg("stop_err")).alias("ausc"), (100 * F.avg(F.abs(F.col("stop_err") - F.col("stop_perr")) / F.greatest(F.col("stop_err"), F.lit(floor)))).alias("ssae"))


def average_curves(curves: DataFrame, session: str = "session") -> DataFrame:
    """pos, n, err, err_est: curves of sessions aligned by position; a session without a value does not count there."""
    c = curves.withColumn("pos", F.row_number().over(Window.partitionBy(session).orderBy("len")) - 1)
    return c.groupBy("pos").agg(F.count("*").alias("n"), F.avg("err").alias("err"), F.avg("err_est").alias("err_est"))


def trial_correct(fy: DataFrame, keys: list[str]) -> DataFrame:
    """keys, correct: whether no other output has a larger sum than object 0."""
    s = fy.groupBy(*keys, "obj").agg(F.round(F.sum("v"), 9).alias("_s"))
    return s.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("obj") == 0, F.col("_s"))), F.lit(0.0)) >= F.coalesce(F.max(F.when(F.col("obj") != 0, F.col("_s"))), F.lit(float("-inf")))).alias("correct"))
