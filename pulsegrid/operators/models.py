"""Model fitting. Sums over samples are Spark aggregates; only matrices of the size of a model reach a helper, one task a
group. A model is a long table: groups, k (component), kind ('w': idx is a channel, 'r': idx is a lag, with evt), v."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.filters import whitener
from pulsegrid.operators import scores, stats
from pulsegrid.shared import cut, ship

MODEL = "k int, kind string, evt string, idx int, v double"


def summary_stats(signal: DataFrame, events: DataFrame, keys: list[str], groups: list[str], tau: int) -> DataFrame:
    """groups, stat ('xx', 'xy', 'yy'), a, b, c, v: covariances of the true output (object 0) as one additive table."""
    true = events.where("obj = 0")
    x, chs = stats.aligned_arrays(signal, keys, groups)
    none = F.lit(None).cast("string")
    ch = lambda d: F.get("chs", F.col(d)).cast("int")
    xx = stats.cov_xx(x, groups).join(chs, groups).select(*groups, F.lit("xx").alias("stat"), none.alias("e1"), none.alias("e2"), ch("d1").alias("a"), ch("d2").alias("b"), "v")
    xy = stats.cov_xy(signal, true, keys, groups, tau).select(*groups, F.lit("xy"), F.col("evt"), none, F.col("lag"), F.col("ch"), "v")
    yy = stats.cov_yy(true, keys, groups, tau).select(*groups, F.lit("yy"), F.col("evt1"), F.col("evt2"), F.col("lag").cast("int"), F.lit(0), "v")
    return xx.union(xy).union(yy)


def nested_stats(signal: DataFrame, events: DataFrame, keys: list[str], groups: list[str], tau: int) -> DataFrame:
    """summary_stats for every response length up to tau from one pass over the signal: groups, stat, e1, e2, a, b, edge, v."""
    true = events.where("obj = 0")
    whole = summary_stats(signal, events.limit(0), keys, groups, tau).where("stat = 'xx'")
    none = F.lit(None).cast("string")
    xy = stats.cov_xy_nested(signal, true, keys, groups, tau).select(*groups, F.lit("xy").alias("stat"), F.col("evt").alias("e1"), none.alias("e2"), F.col("lag").cast("int").alias("a"), F.col("ch").alias("b"), "edge", "v")
    yy = stats.cov_yy(true, keys, groups, tau).select(*groups, F.lit("yy").alias("stat"), F.col("evt1").alias("e1"), F.col("evt2").alias("e2"), F.col("lag").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(tau).alias("edge"), "v")
    return whole.withColumn("edge", F.lit(tau)).select(*xy.columns).union(xy).union(yy)


def sliced_stats(nested: DataFrame, groups: list[str], tau: int) -> DataFrame:
    """The summary_stats of one response length."""
    d = nested.where((F.col("edge") >= tau) & ((F.col("stat") == "xx") | (F.col("a") < tau)))
    return d.groupBy(*groups, "stat", "e1", "e2", "a", "b").agg(F.sum("v").alias("v"))


def updated_stats(signal: DataFrame, events: DataFrame, by: list[str], tau: int, old: DataFrame | None = None, decay: float = 1.0, thresh: float = 4.0) -> DataFrame:
    """Statistics of new trials (by, trial), their outlying trials and channels zeroed first, on top of decay times the older ones."""
    from pulsegrid.functions.clean import zero_outliers

    new = summary_stats(zero_outliers(signal, by, thresh=thresh), events, [*by, "trial"], by, tau)
    return new if old is None else stats.merge_stats(old, new, [*by, "stat", "e1", "e2", "a", "b"], decay)


def _matrices(f: pd.DataFrame, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Cxx (d, d), Cxy (events * tau, d), Cyy (events * tau, events * tau) of one group's table, its events, and the channel
    numbers that stand at the d places."""
    xx, xy, yy = (f[f["stat"] == s] for s in ("xx", "xy", "yy"))
    chs = np.unique(xx["a"].to_numpy(np.int64))
    evts, d = sorted(set(xy["e1"])), len(chs)
    at = {e: i for i, e in enumerate(evts)}
    cxx, cxy, cyy = np.zeros((d, d)), np.zeros((len(evts) * tau, d)), np.zeros((len(evts) * tau,) * 2)
    cxx[np.searchsorted(chs, xx["a"]), np.searchsorted(chs, xx["b"])] = xx["v"]
    for e, lag, ch, v in zip(xy["e1"], xy["a"], np.searchsorted(chs, xy["b"]), xy["v"], strict=True):
        cxy[at[e] * tau + lag, ch] = v
    for e1, e2, lag, v in zip(yy["e1"], yy["e2"], yy["a"], yy["v"], strict=True):
        if e1 in at and e2 in at and lag < tau:  # y[t + lag, e1] meets y[t, e2]: responses at lags i and i + lag
            for i in range(tau - lag):
                cyy[at[e1] * tau + i, at[e2] * tau + i + lag] = v
                cyy[at[e2] * tau + i + lag, at[e1] * tau + i] = v
    return cxx, cxy, cyy, evts, chs


def _rows(f: pd.DataFrame, groups: list[str], parts: list[tuple]) -> pd.DataFrame:
    d = pd.DataFrame(parts, columns=["k", "kind", "evt", "idx", "v"])
    for i, g in enumerate(groups):
        d.insert(i, g, f[g].iloc[0])
    return d


def _fitted(table: DataFrame, groups: list[str], fn) -> DataFrame:
    ship(table.sparkSession)
    kinds = dict(table.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", " + MODEL
    return table.groupBy(*groups).applyInPandas(lambda f: _rows(f, groups, fn(f)), schema)


def fit_cca(table: DataFrame, groups: list[str], tau: int, rank: int = 1, reg_x: float = 1e-6, reg_y: float = 1e-6) -> DataFrame:
    """Canonical correlation of signal and lagged events: both whitened, the leading singular directions of the whitened
    Cxy; r is weighted by its share of the largest correlation. The sign makes each largest spatial weight positive."""

    def fn(f):
        cxx, cxy, cyy, evts, chs = _matrices(f, tau)
        if not cxy.any():
            return []
        wx, wy = whitener(cxx, reg_x, symmetric=False), whitener(cyy, reg_y, symmetric=False)
        u, s, vt = np.linalg.svd(wy.T @ cxy @ wx, full_matrices=False)
        out = []
        for k in range(min(rank, len(s))):
            w, r = wx @ vt[k], wy @ u[:, k] * (s[k] / max(s[0], 1e-12))
            sign = np.sign(w[np.argmax(np.abs(w))]) or 1.0
            out += [(k, "w", None, int(i), float(v * sign)) for i, v in zip(chs, w, strict=True)]
            out += [(k, "r", evts[i // tau], i % tau, float(v * sign)) for i, v in enumerate(r)]
        return out

    return _fitted(table, groups, fn)


def fit_forward(table: DataFrame, groups: list[str], tau: int, reg: float = 0.0) -> DataFrame:
    """Least squares of the signal on lagged events. k is the channel, kind 'r'."""

    def fn(f):
        _, cxy, cyy, evts, chs = _matrices(f, tau)
        if not cxy.any():
            return []
        b = np.linalg.lstsq(cyy + reg * cyy.diagonal().max() * np.eye(len(cyy)), cxy, rcond=None)[0]
        return [(int(ch), "r", evts[i // tau], i % tau, float(b[i, k])) for k, ch in enumerate(chs) for i in range(len(b))]

    return _fitted(table, groups, fn)


def fit_backward(signal: DataFrame, target: DataFrame, keys: list[str], groups: list[str], tau: int, reg: float = 0.0) -> DataFrame:
    """groups, lag, ch, w: least squares of target(keys, samp, v) at t on the signal at t .. t + tau - 1, from window covariances
    that are summed across trials."""
    ship(signal.sparkSession)
    kinds = dict(signal.dtypes)
    t = target.select(*keys, "samp", F.col("v").alias("_y"))
    x, chs = stats.aligned_arrays(signal, keys, groups)
    x = stats.window_arrays(x.join(t, [*keys, "samp"]), keys, tau).withColumn("x", F.concat("x", F.array(F.col("_y").cast("double"))))
    gs = ", ".join(f"{g} {kinds[g]}" for g in groups)
    c = stats.cross_sums(x.withColumn("_x", F.col("x")), groups, "x", "_x")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["i"].max())
        m = np.zeros((n + 1, n + 1))
        m[f["i"], f["j"]] = f["v"]
        w = np.linalg.lstsq(m[:n, :n] + reg * m[:n, :n].diagonal().max() * np.eye(n), m[:n, n], rcond=None)[0]
        d = n // tau
        return pd.DataFrame({**{g: f[g].iloc[0] for g in groups}, "lag": np.arange(n) // d, "ch": np.arange(n) % d, "w": w})

    return c.groupBy(*groups).applyInPandas(solve, f"{gs}, lag int, ch int, w double").join(chs, groups).select(*groups, "lag", F.get("chs", F.col("ch")).cast("int").alias("ch"), "w")


def factored_to_full(model: DataFrame, groups: list[str]) -> DataFrame:
    """groups, evt, lag, ch, w: the sum over components of w times r."""
    w = model.where("kind = 'w'").select(*groups, "k", F.col("idx").alias("ch"), F.col("v").alias("_w"))
    r = model.where("kind = 'r'").select(*groups, "k", "evt", F.col("idx").alias("lag"), F.col("v").alias("_r"))
    return w.join(r, [*groups, "k"]).groupBy(*groups, "evt", "lag", "ch").agg(F.sum(F.col("_w") * F.col("_r")).alias("w"))


def spatial_pattern(model: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    """groups, k, ch, v: covariance times spatial filter."""
    w = model.where("kind = 'w'").select(*groups, "k", F.col("idx").alias("b"), F.col("v").alias("_w"))
    xx = table.where("stat = 'xx'").select(*groups, F.col("a").alias("ch"), "b", F.col("v").alias("_c"))
    return xx.join(w, [*groups, "b"]).groupBy(*groups, "k", "ch").agg(F.sum(F.col("_c") * F.col("_w")).alias("v"))


def predict(signal: DataFrame, events: DataFrame, full: DataFrame, keys: list[str], on: list[str], offset: int = 0, tau: int | None = None) -> DataFrame:
    """keys, samp, obj, v: scores of all outputs by a full model (on, evt, lag, ch, w)."""
    fe = scores.score_stimulus(signal, full.select(*on, "evt", "lag", "ch", "w"), keys, on, offset, tau)
    return scores.score_output(fe, events, keys)


def with_folds(trials: DataFrame, by: list[str], folds: int, trial: str = "trial") -> DataFrame:
    """trials + fold: contiguous blocks of trials in their order."""
    t = trials.select(*by, trial).distinct()
    return t.withColumn("fold", F.ntile(folds).over(Window.partitionBy(*by).orderBy(trial)) - 1)


def cross_validate(signal: DataFrame, events: DataFrame, by: list[str], tau: int, folds: int = 3, ranks: list[int] | None = None, reg: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(fy: by, trial, samp, obj, rank, v of held-out trials; score: by, rank, score). Statistics are summed once a fold; what a
    fold trains on is the total less its own sums. The largest rank is fitted once and cut to the smaller ones."""
    keys = [*by, "trial"]
    f = with_folds(signal, by, folds)
    own = cut(summary_stats(signal.join(f, keys), events.join(f, keys), [*keys, "fold"], [*by, "fold"], tau), "stats")  # one scan, whatever reads it
    return _validated(signal, events, f, own, by, tau, ranks or [1], reg)


def _validated(signal: DataFrame, events: DataFrame, f: DataFrame, own: DataFrame, by: list[str], tau: int, ranks: list[int], reg: float) -> tuple[DataFrame, DataFrame]:
    """cross_validate given the folds of the trials and the statistics of each fold."""
    keys = [*by, "trial"]
    cell = [*by, "stat", "e1", "e2", "a", "b"]
    total = own.groupBy(*cell).agg(F.sum("v").alias("_t"))
    grid = total.join(f.select(*by, "fold").distinct(), by)
    mine = own.select(*[F.col(c).alias(f"_{c}") for c in [*cell, "fold", "v"]])
    on = F.lit(True)
    for c in [*cell, "fold"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    train = grid.join(mine, on, "left").select(*cell, "fold", (F.col("_t") - F.coalesce("_v", F.lit(0.0))).alias("v"))
    model = cut(fit_cca(train, [*by, "fold"], tau, max(ranks), reg, reg), "model")
    full = factored_to_full(model.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks]))).where("k < rank"), [*by, "fold", "rank"])
    at = f.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks])))
    fy = predict(signal.join(at, keys), events.join(at, keys), full, [*keys, "fold", "rank"], [*by, "fold", "rank"], tau=tau)
    fy = fy.select(*keys, "samp", "obj", "rank", "v")
    return fy, scores.audc_score(fy, [*keys, "rank"], [*by, "rank"])


def holdout_eval(signal: DataFrame, events: DataFrame, by: list[str], tau: int, held_out: DataFrame, folds: int = 3, rank: int = 1, reg: float = 1e-6) -> DataFrame:
    """fy (by, trial, samp, obj, v) of all trials, and test: training trials (those not in held_out: by, trial) are predicted by
    cross-validation among themselves, held-out ones by the model of all training trials."""
    keys = [*by, "trial"]
    out = held_out.select(*keys).distinct()
    x, y = (d.join(out, keys, "left_anti") for d in (signal, events))
    own = cross_validate(x, y, by, tau, folds, [rank], reg)[0].select(*keys, "samp", "obj", "v", F.lit(False).alias("test"))
    full = cut(factored_to_full(fit_cca(summary_stats(x, y, keys, by, tau), by, tau, rank, reg, reg), by), "model")
    new = predict(signal.join(out, keys, "left_semi"), events.join(out, keys, "left_semi"), full, keys, by, tau=tau)
    return own.union(new.select(*keys, "samp", "obj", "v", F.lit(True).alias("test")))


def best_rank(score: DataFrame, by: list[str]) -> DataFrame:
    return score.groupBy(*by).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("rank")).alias("r"))).alias("_b")).select(*by, (-F.col("_b.r")).alias("rank"), F.col("_b.score").alias("score"))


def grid_search(signal: DataFrame, events: DataFrame, by: list[str], taus: list[int], ranks: list[int], folds: int = 3, reg: float = 1e-6) -> DataFrame:
    """tau, rank, mean, sd over groups, best first. The statistics are summed in one scan at the largest tau; each smaller tau, and each fold,
    is a slice of that table."""
    f = with_folds(signal, by, folds)
    keys = [*by, "trial"]
    nested = cut(nested_stats(signal.join(f, keys), events.join(f, keys), [*keys, "fold"], [*by, "fold"], max(taus)), "stats")
    out = None
    for tau in taus:
        own = sliced_stats(nested, [*by, "fold"], tau)
        s = _validated(signal, events, f, own, by, tau, ranks, reg)[1].withColumn("tau", F.lit(tau))
        out = s if out is None else out.union(s)
    return out.groupBy("tau", "rank").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).orderBy(F.desc("mean"), "tau", "rank")


def learning_curve(signal: DataFrame, events: DataFrame, by: list[str], tau: int, sizes: list[int], rank: int = 1, reg: float = 1e-6) -> DataFrame:
    """by, size, score on the trials after the first `size`, trained on those. The statistics are summed once a trial; those of the first
    trials are running sums of them."""
    keys = [*by, "trial"]
    order = signal.select(*keys).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("trial")))
    at = order.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    train, test = (at.where(c).select(*keys, "size") for c in ("_n <= size", "_n > size"))
    g = [*by, "size"]
    first = order.where(F.col("_n") <= max(sizes, default=0)).select(*keys)  # no training set holds a later trial
    own = cut(summary_stats(*(d.join(first, keys, "left_semi") for d in (signal, events)), keys, keys, tau), "stats")
    table = own.join(train, keys).groupBy(*g, "stat", "e1", "e2", "a", "b").agg(F.sum("v").alias("v"))
    full = cut(factored_to_full(fit_cca(table, g, tau, rank, reg, reg), g), "model")
    fy = predict(signal.join(test, keys), events.join(test, keys), full, [*keys, "size"], g, tau=tau)
    return scores.audc_score(fy, [*keys, "size"], g)


# --- classifiers by group


def _slopes(kind: str, delta: float):
    """(score, target) -> slope of the loss and its weight in the next step. Targets of the two classifiers are 0 and 1."""

    def logistic(s, y):
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        return p - y, p * (1 - p)

    def hinge(s, y):  # squared
        t = 2 * y - 1
        short = np.maximum(1 - t * s, 0)
        return -t * short, (short > 0).astype(float)

    def huber(s, y):
        r = s - y
        return np.clip(r, -delta, delta), np.minimum(1, delta / np.maximum(np.abs(r), 1e-12))

    return {"logistic": logistic, "hinge": hinge, "huber": huber, "ridge": lambda s, y: (s - y, np.ones_like(s))}[kind]


def fit_by_group(windows: DataFrame, groups: list[str], label: str, kind: str = "ridge", features: str = "win", reg: float = 1.0, delta: float = 1.35, unlabelled: bool = False, rounds: int = 30, tol: float = 1e-8) -> DataFrame:
    """groups, cls, w (weights of the features, then the bias): a linear model a group, from sums alone. ridge and huber (in place of
    support-vector regression) predict the label; logistic and hinge (squared) tell each class from all others. Minimised is the
    sum of losses plus reg / 2 times the squared weights, without the bias.

    Each round is one pass that adds up slopes and curvatures of a group in its tasks, and one small solution a group; a group whose weights have
    settled leaves the next rounds. Rows without a label are left out, or (unlabelled, for classes) are a class of their own, cls null."""
    ship(windows.sparkSession)
    classes = kind in ("logistic", "hinge")
    d = windows.select(*groups, F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("_label"), F.col(label).cast("double").alias("_y"))
    if not (classes and unlabelled):
        d = d.where(F.col("_label").isNotNull())
    d = cut(d, "windows")
    kinds = dict(d.dtypes)
    gs = "".join(f"{g} {kinds[g]}, " for g in groups)
    start = d.groupBy(*groups).agg(F.max(F.size("x")).alias("p"))
    names = d.select(*groups, "_label").distinct() if classes else start.select(*groups, F.lit("y").alias("_label"))  # a few a group
    model = cut(names.join(start, groups).select(*groups, F.col("_label").alias("cls"), F.array_repeat(F.lit(0.0), F.col("p") + 1).alias("w")), "model")
    slope, done = _slopes(kind, delta), []

    def sums(frames):
        held: dict[tuple, list] = {}

        def spilled():
            for g, (h, s) in held.items():
                yield pd.DataFrame(dict(zip(groups, g, strict=True)) | {"pos": np.arange(h.size + s.size), "v": np.concatenate([h.ravel(), s.ravel()])})
            held.clear()

        for f in frames:
            for g, part in f.groupby(groups) if groups else [((), f)]:
                x = np.array(part["x"].tolist(), float)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                ws = np.array(part["ws"].iloc[0].tolist(), float)  # of the classes of the group
                score = x @ ws.T
                y = np.array(part["ys"].tolist(), float)
                first, second = slope(score, y)
                got = held.setdefault(g if isinstance(g, tuple) else (g,), [0.0, 0.0])
                got[0] = got[0] + np.einsum("nc,np,nq->cpq", second, x, x, optimize=True)
                got[1] = got[1] + first.T @ x
            if len(held) > 64:
                yield from spilled()
        yield from spilled()

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        ws = np.array(f["ws"].iloc[0].tolist(), float)
        c, p = ws.shape
        v = np.zeros(c * p * (p + 1))
        v[f["pos"]] = f["v"]
        h, s = v[: c * p * p].reshape(c, p, p), v[c * p * p :].reshape(c, p)
        keep = reg * (np.arange(p) < p - 1)
        new = np.array([w - np.linalg.lstsq(a + np.diag(keep) + 1e-12 * np.eye(p), b + keep * w, rcond=None)[0] for w, a, b in zip(ws, h, s, strict=True)])
        names = list(f["clss"].iloc[0])
        return pd.DataFrame({**{g: [f[g].iloc[0]] * c for g in groups}, "cls": names, "w": new.tolist(), "moved": [float(np.abs(new - ws).max())] * c})

    for _ in range(1 if kind == "ridge" else rounds):
        both = F.array_sort(F.collect_list(F.struct(F.col("cls").isNull().alias("n"), "cls", "w")))
        packed = model.groupBy(*groups).agg(both.alias("_m")).select(*groups, F.transform("_m", lambda m: m["cls"]).alias("clss"), F.transform("_m", lambda m: m["w"]).alias("ws"))
        rows = d.join(packed, groups) if groups else d.crossJoin(F.broadcast(packed))
        target = F.transform("clss", lambda c: c.eqNullSafe(F.col("_label")).cast("double")) if classes else F.array(F.col("_y"))
        total = rows.select(*groups, "x", "ws", target.alias("ys")).mapInPandas(sums, f"{gs}pos bigint, v double").groupBy(*groups, "pos").agg(F.sum("v").alias("v"))
        total = total.join(packed, groups) if groups else total.crossJoin(F.broadcast(packed))
        new = cut(total.groupBy(*groups).applyInPandas(solve, f"{gs}cls string, w array<double>, moved double"), "model")
        done.append(new.where(F.col("moved") <= tol).drop("moved"))
        model = new.where(F.col("moved") > tol).drop("moved")
        if kind == "ridge":
            return new.drop("moved")
        if not model.take(1):
            model = model.limit(0)
            break
    for x in done:
        model = model.union(x)
    return model


def classify(windows: DataFrame, model: DataFrame, groups: list[str], kind: str = "ridge", features: str = "win") -> DataFrame:
    """windows + scores (array of cls, score) and prediction: the label of the largest score (the first on ties), or the value."""
    m = model.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col("cls").isNull().alias("n"), "cls", "w"))).alias("_m"))
    dot = lambda w: F.aggregate(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.col(features).cast("array<double>"), lambda a, b: a * b), F.element_at(w, -1), lambda a, b: a + b)
    d = (windows.join(m, groups) if groups else windows.crossJoin(F.broadcast(m))).withColumn("scores", F.transform("_m", lambda m: F.struct(m["cls"].alias("cls"), dot(m["w"]).alias("score")))).drop("_m")
    if kind not in ("logistic", "hinge"):
        return d.withColumn("prediction", F.get("scores", F.lit(0))["score"])
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    return d.withColumn("_best", best).withColumn("prediction", F.get(F.filter("scores", lambda s: s["score"] == F.col("_best")), F.lit(0))["cls"]).drop("_best")


def fit_classifier(windows: DataFrame, label: str, kind: str = "ridge", features: str = "win"):
    """A pyspark.ml model on window features (arrays of numbers): ridge, huber (in place of support-vector regression), logistic
    or svc. Rows without a label are left out."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    d = windows.where(F.col(label).isNotNull()).select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    est = {"ridge": LinearRegression(regParam=0.1), "huber": LinearRegression(loss="huber", regParam=0.1), "logistic": LogisticRegression(regParam=0.01), "svc": OneVsRest(classifier=LinearSVC(regParam=0.01))}[kind]
    return est.fit(d)
