"""Scores of stimuli and outputs, their normalisation, and target probabilities.

Long tables: fe(keys, samp, evt, v), y(keys, samp, obj, evt, v), fy(keys, samp, obj, v). A score of 0 means inactive; rows
that are absent count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import cut, deal


def _run(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def score_stimulus(signal: DataFrame, model: DataFrame, keys: list[str], on: list[str] | None = None, offset: int = 0, tau: int | None = None) -> DataFrame:
    """keys, samp, evt, v: sum over lags and channels of x[samp + lag, ch] * w[evt, lag, ch], for samples with the whole
    response inside the trial, moved so that out[samp] = score[samp + offset]. model: (on), evt, lag, ch, w and bias rows with
    lag null. The model is joined on `on` (none: one model for all). tau: the length of the response, else a job reads it from the model."""
    on = on or []
    w = model.where("lag is not null")
    tau = tau or w.agg(F.max("lag")).first()[0] + 1
    last = signal.groupBy(*keys).agg(F.max("samp").alias("_last"))
    j = signal.join(w, [*on, "ch"]).withColumn("_at", F.col("samp") - F.col("lag")).where("_at >= 0")
    s = j.groupBy(*keys, "evt", "_at").agg(F.sum(F.col("v") * F.col("w")).alias("v")).join(last, keys).where(F.col("_at") <= F.col("_last") + 1 - tau)
    b = model.where("lag is null").select(*on, "evt", F.col("w").alias("_b"))
    s = s.join(b, [*on, "evt"], "left")
    return s.select(*keys, (F.col("_at") - offset).alias("samp"), "evt", (F.col("v") + F.coalesce("_b", F.lit(0.0))).alias("v")).where("samp >= 0")


def score_epochs(epochs: DataFrame, model: DataFrame, keys: list[str], on: list[str] | None = None, spatial: DataFrame | None = None, bias: DataFrame | None = None) -> DataFrame:
    """keys, evt, v of pre-sliced epochs (keys, lag, ch, v). A full model is (on), evt, lag, ch, w and has no bias. With spatial
    filters (on), k, ch, w the model is (on), k, evt, lag, r, and bias (evt, b) is added."""
    on = on or []
    if spatial is None:
        return epochs.join(model, [*on, "lag", "ch"]).groupBy(*keys, "evt").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    part = epochs.join(spatial, [*on, "ch"]).groupBy(*keys, "lag", "k").agg(F.sum(F.col("v") * F.col("w")).alias("_c"))
    s = part.join(model, [*on, "k", "lag"]).groupBy(*keys, "evt").agg(F.sum(F.col("_c") * F.col("r")).alias("v"))
    if bias is not None:
        s = s.join(bias, "evt", "left").withColumn("v", F.col("v") + F.coalesce("b", F.lit(0.0))).drop("b")
    return s


def score_output(fe: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, obj, v = sum over events of fe * y."""
    f = fe.select(*keys, "samp", "evt", F.col("v").alias("_f"))
    return y.where("v <> 0").join(f, [*keys, "samp", "evt"]).groupBy(*keys, "samp", "obj").agg(F.sum(F.col("v") * F.col("_f")).alias("v"))


def score_output_offsets(fe: DataFrame, y: DataFrame, keys: list[str], offsets: list[int]) -> DataFrame:
    """As score_output for each offset o (a column `offset`): fe[samp] meets y[samp - o]."""
    moved = y.where("v <> 0").withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("samp", F.col("samp") + F.col("offset"))
    return score_output(fe.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))), moved, [*keys, "offset"])


def conv_yr(y: DataFrame, response: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """keys, samp, obj, k, v: sum over events and lags of y[samp - lag] * r[k, evt, lag]."""
    j = y.where("v <> 0").join(response, [*(on or []), "evt"]).withColumn("samp", F.col("samp") + F.col("lag"))
    return j.groupBy(*keys, "samp", "obj", "k").agg(F.sum(F.col("v") * F.col("r")).alias("v"))


def score_output_sse(fe: DataFrame, y: DataFrame, response: DataFrame, keys: list[str]) -> DataFrame:
    """score_output minus half the squared length of the predicted response."""
    ip = score_output(fe, y, keys)
    sq = conv_yr(y, response, keys).groupBy(*keys, "samp", "obj").agg((F.sum(F.col("v") * F.col("v")) / 2).alias("_q"))
    return ip.join(sq, [*keys, "samp", "obj"], "left").withColumn("v", F.col("v") - F.coalesce("_q", F.lit(0.0))).drop("_q")


def spatial_filter(signal: DataFrame, filters: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """keys, samp, k, v: the signal on each component. filters: (on), k, ch, w."""
    return signal.join(filters, [*(on or []), "ch"]).groupBy(*keys, "samp", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def conv_xyr(wx: DataFrame, yr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, obj, v: signal components times predicted responses, summed over components."""
    return yr.join(wx.select(*keys, "samp", "k", F.col("v").alias("_x")), [*keys, "samp", "k"]).groupBy(*keys, "samp", "obj").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def densify(fy: DataFrame, keys: list[str]) -> DataFrame:
    """Every sample up to the last and every object of the key, absent scores as 0. The rows are dealt by key once, and each fills the gap before it
    (an object's last one also the samples after it); what follows by key, object or sample needs no further shuffle."""
    f = deal(fy.where("obj is not null and samp >= 0").select(*keys, "obj", F.col("samp").cast("bigint").alias("_at"), F.col("v").alias("_v")), keys)
    w = Window.partitionBy(*keys, "obj").orderBy("_at")
    f = f.withColumn("_low", F.least(F.coalesce(F.lag("_at").over(w) + 1, F.lit(0).cast("bigint")), "_at")).withColumn("_end", F.lead("_at").over(w).isNull())
    f = f.withColumn("_high", F.when(F.col("_end"), F.max("_at").over(Window.partitionBy(*keys))).otherwise(F.col("_at")))
    v = F.coalesce(F.when(F.col("samp") == F.col("_at"), F.col("_v")), F.lit(0.0)).alias("v")
    return f.withColumn("samp", F.explode(F.sequence("_low", "_high"))).select(*keys, "obj", "samp", v)


def dedup_true_output(fy: DataFrame, keys: list[str], zero_copy: bool = True, least: float = 0.95) -> DataFrame:
    """Per trial the output most like object 0 (share of equal samples, the first on ties): above `least` it is zeroed, or
    object 0 is. Trials where object 0 is all zero stay as they are."""
    d = densify(fy, keys)
    true = d.where("obj = 0").select(*keys, "samp", F.col("v").alias("_t"))
    alive = true.groupBy(*keys).agg(F.max((F.col("_t") != 0).cast("int")).alias("_a")).where("_a = 1").drop("_a")
    sim = d.where("obj <> 0").join(true, [*keys, "samp"]).join(alive, keys, "left_semi").groupBy(*keys, "obj").agg(F.avg((F.col("v") == F.col("_t")).cast("double")).alias("_s"))
    best = sim.groupBy(*keys).agg(F.max(F.struct("_s", -F.col("obj"))).alias("_b")).where(F.col("_b._s") > least)
    gone = best.select(*keys, (-F.col("_b.col2") if zero_copy else F.lit(0)).cast("bigint").alias("_gone"))
    return d.join(gone, keys, "left").withColumn("v", F.when(F.col("obj") == F.col("_gone"), 0.0).otherwise(F.col("v"))).drop("_gone")


def audc_score(fy: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """score (by `within`): the share of (trial with a true score, sample) where object 0 leads the running sums; the lowest
    object wins ties."""
    d = densify(fy, keys)
    good = F.max(((F.col("obj") == 0) & (F.col("v") != 0)).cast("int")).over(Window.partitionBy(*keys))
    s = d.withColumn("_c", F.sum("v").over(_run([*keys, "obj"], "samp"))).withColumn("_good", good).where("_good = 1")
    lead = s.groupBy(*keys, "samp").agg(F.max(F.struct(F.round("_c", 9).alias("c"), (-F.col("obj")).alias("o"))).alias("_l"))
    return lead.groupBy(*(within or [])).agg(F.avg((F.col("_l.o") == 0).cast("double")).alias("score"))


def model_weights(fy: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """fy of all models, weighted by the softmax of their total score."""
    t = fy.groupBy(model).agg(F.sum("v").alias("_t"))
    w = Window.partitionBy()
    t = t.withColumn("_e", F.exp(F.col("_t") - F.max("_t").over(w))).withColumn("_w", F.col("_e") / F.sum("_e").over(w)).select(model, "_w")  # one row a model
    return fy.join(F.broadcast(t), model).groupBy(*keys, "samp", "obj").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def valid_outputs(fy: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ny (outputs with any score), nep (index of the last active sample)."""
    a = fy.groupBy(*keys, "obj").agg(F.max(F.when(F.col("v") != 0, F.col("samp"))).alias("_s"))
    return a.groupBy(*keys).agg(F.count("_s").alias("ny"), F.coalesce(F.max("_s"), F.lit(0)).alias("nep"))


def decision_points(n: int, least: int, most: int = 0) -> list[int]:
    """Sample indices at which a decision is made over n samples: doubling from `least`, every -least, or the last only."""
    import math

    if n < 1:
        return []
    points = [n - 1]
    if 0 < least < n:
        steps = math.ceil(math.log2((n - 1) / least)) if n - 1 > least else 0
        points = [min(max(2**i * least, least), n - 1) for i in range(max(steps, 0) + 1)]
    elif least < 0:
        points = [*range(-least - 1, n - 1, -least), n - 1]
    if most > 0 and most >= points[0]:
        points = [p for p in points if p <= most]
    return points


def decision_grid(trials: DataFrame, n: str = "n", least: int = -1) -> DataFrame:
    """trials + samp: the decision points of each trial's own length, as rows."""
    last = F.col(n) - 1
    if least < 0:
        points = F.array_union(F.when(last > -least - 1, F.sequence(F.lit(-least - 1).cast("bigint"), last.cast("bigint"), F.lit(-least).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.array(last.cast("bigint")))
    elif least > 0:
        steps = F.greatest(F.ceil(F.log2(last / least)), F.lit(0)).cast("int")
        points = F.when(last > least, F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda i: F.least(F.pow(F.lit(2.0), i).cast("bigint") * least, last.cast("bigint"))))).otherwise(F.array(last.cast("bigint")))
    else:
        points = F.array(last.cast("bigint"))
    return trials.withColumn("samp", F.explode(points))


def cumulative_scores(fy: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, obj, v, s (running sum), n (running count of active samples), ny. Windows over the rows as densify dealt them, without a join."""
    on = (F.col("v") != 0).cast("int")
    run, end = _run([*keys, "obj"], "samp"), F.lead("samp").over(Window.partitionBy(*keys, "obj").orderBy("samp")).isNull()
    d = densify(fy, keys).withColumn("s", F.sum("v").over(run)).withColumn("_used", F.when(end, F.max(on).over(run)))
    at = Window.partitionBy(*keys, "samp").orderBy("obj")
    first = F.when(F.row_number().over(at) == 1, F.max(on).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = d.withColumn("_first", first).withColumn("n", F.sum("_first").over(Window.partitionBy(*keys).orderBy("samp")))  # with all objects of the sample
    d = d.withColumn("ny", F.sum("_used").over(Window.partitionBy(*keys)))
    return d.select(*keys, "samp", "obj", "v", "s", "n", "ny")


def noise_variance(fy: DataFrame, keys: list[str], centre: bool = True, compact: bool = False, prior: tuple[float, float] | None = None, running: DataFrame | None = None) -> DataFrame:
    """keys, samp, n, sigma2: the variance over outputs of the running sums, by sample so far, averaged over time. Centred over
    the active outputs where each trial has more than three (compact: where this trial has). compact leaves inactive samples out.
    prior (sigma2, count) mixes with the index of the sample, or with n if compact. running: the cumulative_scores of fy, where they are at hand."""
    c = cumulative_scores(fy, keys) if running is None else running
    if compact:
        c = c.where("ny > 0")
        c = c.join(c.groupBy(*keys, "samp").agg(F.max((F.col("v") != 0).cast("int")).alias("_on")).where("_on = 1").drop("_on"), [*keys, "samp"])
        all_many = F.col("ny") > 3
    else:
        all_many = F.lit(bool(((valid_outputs(fy, keys) if running is None else c).agg(F.min("ny")).first()[0] or 0) > 3))
    a = c.groupBy(*keys, "samp", "n", "ny").agg(F.sum("s").alias("_s"), F.sum(F.col("s") * F.col("s")).alias("_q"), F.count("*").alias("_k"))
    mu = F.col("_s") / F.col("ny")
    ss = F.when(all_many, F.col("_q") - 2 * mu * F.col("_s") + F.col("ny" if compact else "_k") * mu * mu).otherwise(F.col("_q")) if centre else F.col("_q")
    n = F.greatest(F.lit(0.1), F.col("n"))
    a = a.withColumn("_v", ss / F.greatest(F.lit(0.1), F.col("ny") - 1) / n)
    a = a.withColumn("sigma2", F.sum("_v").over(_run(keys, "samp")) / n)
    if prior and prior[0] > 0:
        count = F.col("n") if compact else F.col("samp")
        a = a.withColumn("sigma2", (F.col("sigma2") * count + prior[0] * prior[1]) / (count + prior[1]))
    return a.select(*keys, "samp", "n", "sigma2")


def c4(n: Column) -> Column:
    n = F.greatest(F.lit(1.0), n.cast("double"))
    return 1 - F.lit(0.25) / n - F.lit(7 / 32) / (n * n) - F.lit(19 / 128) / (n * n * n)


def normalize_scores(fy: DataFrame, keys: list[str], correction: float = 0.0, norm_sum: bool = True, prior: tuple[float, float] | None = None, at: list[int] | None = None) -> DataFrame:
    """keys, samp, obj, z: running sums over their noise scale, at every sample, or at the samples `at` alone. The running sums are built and written
    once; noise and scores are both read from that table."""
    c = cut(cumulative_scores(fy, keys), "running")
    sig = noise_variance(fy, keys, prior=prior, running=c)
    if at is not None:
        c, sig = (d.where(F.col("samp").isin([int(k) for k in at])) for d in (c, sig))
    scale = F.sqrt(F.col("sigma2") * F.greatest(F.lit(0.01), F.col("n"))) if norm_sum else F.sqrt("sigma2")
    if correction > 0:
        scale = scale / c4(F.col("n") / max(1.0, correction))
    sig = sig.withColumn("_scale", scale).select(*keys, "samp", F.when(F.col("_scale") == 0, 1.0).otherwise(F.col("_scale")).alias("_scale"))
    c = c.select(*keys, "samp", "obj", "s")
    return c.join(sig, [*keys, "samp"]).select(*keys, "samp", "obj", (F.col("s") / F.col("_scale")).alias("z"))


def smooth_scores(fy: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """A causal filter; at the start the weights that have a sample are scaled up to the whole."""
    d = densify(fy, keys)
    w = Window.partitionBy(*keys, "obj").orderBy("samp")
    total, seen = F.lit(0.0), F.lit(0.0)
    for k, b in enumerate(weights):
        x = F.col("v") if k == 0 else F.lag("v", k).over(w)
        total = total + F.coalesce(x, F.lit(0.0)) * b
        seen = seen + F.when(F.col("samp") >= k, abs(b)).otherwise(0.0)
    return d.withColumn("v", total / seen)


def normalize_blocks(fy: DataFrame, keys: list[str], block: int = 30) -> DataFrame:
    """keys, blk, obj, z: sums at the end of each whole block over sqrt(n sigma2); sigma2 is the variance of what is left of
    each block after samples and outputs are centred, half old and half new from block to block."""
    d = densify(fy, keys)
    used = F.max((F.col("v") != 0).cast("int")).over(Window.partitionBy(*keys, "obj"))
    length = Window.partitionBy(*keys)
    d = d.withColumn("_u", used).withColumn("_len", F.max("samp").over(length) + 1).withColumn("blk", F.floor(F.col("samp") / block))
    d = d.where((F.col("_u") == 1) & (F.col("blk") < F.floor(F.col("_len") / block)))
    by = [*keys, "blk"]
    r = F.col("v") - F.avg("v").over(Window.partitionBy(*by, "samp")) - F.avg("v").over(Window.partitionBy(*by, "obj")) + F.avg("v").over(Window.partitionBy(*by))
    b = d.withColumn("_r", r).groupBy(*by).agg((F.sum(F.col("_r") * F.col("_r")) / F.greatest(F.lit(1), F.count("*") - F.countDistinct("obj"))).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    seq = F.array_sort(F.collect_list(F.struct("blk", "_v")).over(w))  # the blocks of one trial
    mixed = F.aggregate(F.slice(seq, 2, 1 << 30), F.element_at(seq, 1)["_v"], lambda acc, x: (acc + x["_v"]) / 2)
    b = b.withColumn("_s2", mixed).select(*by, "_s2")
    s = d.groupBy(*by, "obj").agg(F.sum("v").alias("_s")).withColumn("_s", F.sum("_s").over(_run([*keys, "obj"], "blk")))
    return s.join(b, by).select(*by, "obj", (F.col("_s") / F.when(F.col("_s2") > 0, F.sqrt((F.col("blk") + 1) * block * F.col("_s2"))).otherwise(1.0)).alias("z"))


def decode_streamed(fy: DataFrame, keys: list[str], block: int = 30, scale: float = 3.0) -> DataFrame:
    """keys, blk, yest, perr: after each whole block the likeliest output of the block-normalised scores."""
    z = normalize_blocks(fy, keys, block).withColumnRenamed("blk", "samp")  # an output is valid for its whole trial
    return select_output(target_probs(z, [*keys, "samp"], scale), [*keys, "samp"]).withColumnRenamed("samp", "blk")


def target_probs(z: DataFrame, keys: list[str], scale: float = 1.0, value: str = "z", prior: str | None = None, over: list[str] | None = None) -> DataFrame:
    """z + p: the softmax of scale * z over the outputs of a key that have any score; outputs without get 0. over: more columns
    (model, decision) over which the softmax runs and p is summed. A null or NaN score makes its whole key 0."""
    over = over or []
    part = [k for k in keys if k not in over]
    base = [k for k in part if k != "samp"]
    w = Window.partitionBy(*part)
    f = F.col(value) * scale + (F.log(F.greatest(F.col(prior), F.lit(1e-8))) if prior else F.lit(0.0))
    if base:  # dealt by trial once: outputs and samples of a trial are then at hand
        z = deal(z, base)
    d = z.withColumn("_f", f).withColumn("_ok", F.max((F.col(value) != 0).cast("int")).over(Window.partitionBy(*[k for k in base if k not in over], "obj")))
    bad = F.max((F.isnan(value) | F.col(value).isNull()).cast("int")).over(w)
    d = d.withColumn("_e", F.exp(F.col("_f") - F.max("_f").over(w)) * F.col("_ok")).withColumn("_bad", bad)
    d = d.withColumn("p", F.when(F.col("_bad") == 1, 0.0).otherwise(F.col("_e") / F.greatest(F.sum("_e").over(w), F.lit(1e-6))))
    if over:
        return d.groupBy(*part, "obj").agg(F.sum("p").alias("p"))
    return d.drop("_f", "_ok", "_e", "_bad")


def marginalize_scores(f: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, v: the sum of f * softmax(f) over the rows of a key."""
    w = Window.partitionBy(*keys)
    d = f.withColumn("_e", F.exp(F.col(value) - F.max(value).over(w)))
    return d.groupBy(*keys).agg((F.sum(F.col(value) * F.col("_e")) / F.sum("_e")).alias("v"))


def entropy(p: DataFrame, keys: list[str]) -> DataFrame:
    return p.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-8)))).alias("entropy"))


#: The scales that the calibration tries.
SCALES = [0.01, 0.02, 0.04, 0.06, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0]


def calibrate_softmax(z: DataFrame, keys: list[str], scales: list[float] = SCALES) -> DataFrame:
    """scale, loss: the scale of least -sum ln max(p of object 0, 1e-5) over trials with a true score (one row). All scales are tried on the outputs of
    a sample where they stand: a sum a scale, no row a scale."""
    base = [k for k in keys if k != "samp"]
    d = deal(z, base) if base else z
    d = d.withColumn("_on", F.max((F.col("z") != 0).cast("int")).over(Window.partitionBy(*base, "obj")))
    good = F.max(F.when(F.col("obj") == 0, F.col("_on"))).over(Window.partitionBy(*base)) == 1
    d = d.withColumn("_good", good).where("_good")
    all_z = F.collect_list(F.struct(F.coalesce("z", F.lit(float("nan"))).alias("z"), "obj", "_on"))  # the outputs of one sample
    rows = d.groupBy(*keys).agg(all_z.alias("_o")).withColumn("_zs", F.transform("_o", lambda o: o["z"]))
    bad, high, low = F.exists("_zs", F.isnan), F.array_max("_zs"), F.array_min("_zs")

    def loss(scale):
        top = (high if scale >= 0 else low) * scale
        e = lambda o: F.exp(o["z"] * scale - top) * o["_on"]
        add = lambda a, b: a + b
        total = F.greatest(F.aggregate(F.transform("_o", e), F.lit(0.0), add), F.lit(1e-6))
        true = F.filter("_o", lambda o: o["obj"] == 0)
        one = lambda o: F.log(F.greatest(F.when(bad, 0.0).otherwise(e(o) / total), F.lit(1e-5)))
        return F.aggregate(F.transform(true, one), F.lit(0.0), add)

    sums = rows.agg(*[(-F.sum(loss(x))).alias(f"l{i}") for i, x in enumerate(scales)])
    tried = F.array(*[F.struct(F.round(f"l{i}", 6).alias("loss"), F.lit(x).alias("scale")) for i, x in enumerate(scales)])
    return sums.select(F.array_min(F.filter(tried, lambda t: t["loss"].isNotNull())).alias("_m")).select("_m.scale", "_m.loss")


def combine_probs(p: DataFrame, keys: list[str]) -> DataFrame:
    """keys, obj, p: the softmax over objects of sum ln p / sqrt(n) over the rows of each object."""
    c = p.groupBy(*keys, "obj").agg((F.sum(F.log(F.greatest(F.col("p"), F.lit(1e-8)))) / F.sqrt(F.count("*"))).alias("_l"))
    w = Window.partitionBy(*keys)
    e = c.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    return e.select(*keys, "obj", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def select_output(p: DataFrame, keys: list[str]) -> DataFrame:
    """keys, yest, perr: the likeliest object (the lowest on ties) and 1 - its probability."""
    b = p.groupBy(*keys).agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("obj")).alias("o"))).alias("_b"))
    return b.select(*keys, (-F.col("_b.o")).alias("yest"), (1 - F.col("_b.p")).alias("perr"))


def sparse_distribution(p: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """The objects of non-zero probability, and object 0 always."""
    return p.where((F.col("p") > least) | (F.col("obj") == 0))
