"""Sequential filters by blocks of samples; spectra and whitening by trial and group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.window import Window

from pulsegrid.operators import blocks
from pulsegrid.shared import cut, ship


# --- design


def butter_sections(order: int, band: tuple[float, float] | float, fs: float, kind: str | None = None) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a Butterworth filter by the bilinear transform. A negative cut-off counts
    back from half the sampling rate (-1: half itself). Without a kind a band that starts at 0 is removed (highpass), one that
    ends at half the rate is removed (lowpass), any other is a stop band."""
    half = fs / 2
    f = [half + x + 1 if x < 0 else x for x in (band if isinstance(band, (tuple, list)) else (band,))]
    if kind is None:
        low, high = f[0] <= 0, f[-1] >= half
        kind, f = ("highpass", f[-1:]) if low else ("lowpass", f[:1]) if high else ("bandstop", f)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = [2 * fs * np.tan(np.pi * x / fs) for x in f]
    zeros, gain = np.array([]), 1.0
    if kind == "lowpass":
        poles, gain = poles * w[0], w[0] ** order
    elif kind == "highpass":
        gain, zeros, poles = np.real(1 / np.prod(-poles)), np.zeros(order), w[0] / poles
    else:
        width, mid = w[1] - w[0], w[0] * w[1]
        if kind == "bandpass":
            half_p, zeros, gain = poles * width / 2, np.zeros(order), width**order
        else:
            gain, half_p = np.real(1 / np.prod(-poles)), width / 2 / poles
            zeros = np.concatenate([np.full(order, 1j), np.full(order, -1j)]) * np.sqrt(mid)
        root = np.sqrt(half_p.astype(complex) ** 2 - mid)
        poles = np.concatenate([half_p + root, half_p - root])
    k = 2 * fs
    gain = np.real(gain * np.prod(k - zeros) / np.prod(k - poles))
    zd = np.concatenate([(k + zeros) / (k - zeros), -np.ones(len(poles) - len(zeros))]).astype(complex)
    pd_ = (k + poles) / (k - poles)
    return _sections(zd, pd_, gain)


def _sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    def pairs(r: np.ndarray) -> list[np.ndarray]:
        up = sorted((x for x in r if x.imag > 1e-12), key=lambda x: (abs(x), x.real))
        real = sorted((x.real for x in r if abs(x.imag) <= 1e-12))
        out = [np.array([1.0, -2 * x.real, abs(x) ** 2]) for x in up]
        while real:
            a = real.pop()
            out.append(np.array([1.0, -(a + real[0]), a * real.pop(0)]) if real else np.array([1.0, -a, 0.0]))
        return out

    num, den = pairs(z), pairs(p)
    sos = np.array([np.concatenate([n, d]) for n, d in zip(num, den, strict=True)])
    sos[0, :3] *= gain
    return sos


# --- by session, in order of time


def _by(df: DataFrame, keys: list[str], order: str, fn, x: str = "x") -> DataFrame:
    """fn: (samples, channels) array -> array of the same length, for each key: for what needs a whole trial (spectra)."""
    b = blocks.to_blocks(df, keys, None, order=order, x=x)
    return blocks._rows(blocks._map(b, keys, blocks.ROW, lambda rows, _: {"_r": blocks._packed(rows[0], rows[1], fn(rows[2]))}), df, keys, None)


def iir_filter(df: DataFrame, keys: list[str], fs: float, bands: list, order: int = 4, size: int = blocks.SIZE) -> DataFrame:
    """A cascade of Butterworth sections over each session, block by block, from the steady state of the first sample."""
    return blocks.linear_blocks(df, keys, [blocks.Linear.sections(np.concatenate([butter_sections(order, b, fs) for b in bands]))], size=size)


def fft_filterbank(df: DataFrame, keys: list[str], fs: float, bands: list[tuple[float, float]]) -> DataFrame:
    """Each band (low <= |f| < high) of each channel becomes a channel."""

    def fn(x):
        f, s = np.abs(np.fft.fftfreq(len(x), 1 / fs)), np.fft.fft(x, axis=0)
        return np.concatenate([np.real(np.fft.ifft(s * ((f >= a) & (f < b))[:, None], axis=0)) for a, b in bands], axis=1)

    return _by(df, keys, "samp", fn)


def iir_filterbank(df: DataFrame, keys: list[str], fs: float, bands: list[tuple[float, float]], order: int = 4, size: int = blocks.SIZE) -> DataFrame:
    """Each band of each channel becomes a channel; all bands run over a block together."""
    return blocks.linear_blocks(df, keys, [blocks.Linear.sections(butter_sections(order, b, fs, "bandpass")) for b in bands], size=size)


def standardize_power(df: DataFrame, groups: list[str], trial: str = "trial", alpha: float = 1e-3, reg: float = 0.1, size: int = blocks.SIZE) -> DataFrame:
    """Each channel in units of its running power, which is averaged with reg times that of the median channel. The running
    powers are a linear recursion over all trials of a group, so blocks of samples are scanned; they begin at the first sample's power,
    or at 1 where that is 0. The median is taken sample by sample."""

    def scaled(x, ys):
        return x * np.sqrt(2 / (ys[0] + reg * np.median(ys[0], axis=1, keepdims=True)))

    begin = lambda system, u: np.where(u > 0, u, 1 / (1 - alpha))[None]
    return blocks.linear_blocks(df, groups, [blocks.Linear.average(alpha)], np.square, begin, scaled, trial, size)


class Predictor:
    """What one block of decorrelate_ar hands to the next: weights (taps, channels), powers, and the samples of the open trial that the
    next prediction looks at."""

    def __init__(self, taps: int, channels: int):
        self.taps, self.weights, self.power, self.trial, self.past = taps, np.eye(taps, 1, 1 - taps) * np.ones(channels), np.ones(channels), None, np.zeros((0, channels))

    @classmethod
    def opened(cls, flat: np.ndarray | None, taps: int, channels: int) -> Predictor:
        p = cls(taps, channels)
        if flat is not None:
            grid = flat[1:].reshape(-1, channels)
            p.trial, p.weights, p.power, p.past = flat[0], grid[:taps], grid[taps], grid[taps + 1 :]
        return p

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.trial], self.weights.ravel(), self.power, self.past.ravel()])

    def learn(self, trial: int, x: np.ndarray, eta: float) -> np.ndarray:
        """Predictions of the samples of a trial's next part; 0 where fewer than `taps` samples came before."""
        if trial != self.trial:
            self.trial, self.power, self.past = trial, np.ones(x.shape[1]), x[:0]
        held = len(self.past)
        whole, guess = np.concatenate([self.past, x]), np.zeros_like(x)
        first, weights = max(held, self.taps), self.weights.copy()
        smooth, _ = blocks.Linear.average(eta).run(np.square(whole[first:]), self.power[None])
        pace = eta / smooth
        for k, t in enumerate(range(first, len(whole))):
            seen = whole[t - self.taps : t]
            g = guess[t - held] = np.add.reduce(weights * seen, 0)
            weights += seen * (pace[k] * (whole[t] - g))
        self.weights = weights
        self.power, self.past = smooth[-1] if len(smooth) else self.power, whole[-self.taps :]
        return guess


def decorrelate_ar(df: DataFrame, groups: list[str], trial: str = "trial", taps: int = 50, eta: float = 1e-7, reg: float = 0.5, size: int = blocks.SIZE) -> DataFrame:
    """Each channel less reg times its linear prediction from the last taps samples of its trial; the first taps stay. The weights
    predict the last sample at first, learn by gradient steps scaled by the smoothed power (1 at the start of a trial), and flow
    through all trials of a group, from block file to block file."""

    def fn(rows, state):
        trials, _, x = rows
        p, out = Predictor.opened(state, taps, x.shape[1]), x.copy()
        edges = [0, *(np.flatnonzero(np.diff(trials)) + 1), len(x)]
        for a, b in zip(edges, edges[1:], strict=False):
            out[a:b] -= reg * p.learn(trials[a], x[a:b], eta)
        return out, p.flat()

    return blocks.in_sequence(df, groups, fn, trial, size)


class PowerTracker:
    """Decayed power around the decayed mean of each channel. car: with more than four channels a sample is first referenced to the
    mean of the active channels (power over a thousandth of the largest one; all at the first sample)."""

    def __init__(self, halflife: float, mean_halflife: float | None = None, car: bool = True, state: np.ndarray | None = None):
        self.keep, self.keep_mean, self.car = 0.5 ** (1 / halflife), 0.5 ** (1 / (mean_halflife or halflife)), car
        self.counts, self.sums = (np.zeros(2), None) if state is None else (state[:2], state[2:].reshape(2, -1))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.counts, self.sums.ravel()])

    def power(self) -> np.ndarray:
        return self.sums[1] / self.counts[1]

    def run(self, x: np.ndarray) -> np.ndarray:
        """The power after each sample."""
        out = np.empty_like(x)
        if self.sums is None:
            self.sums = np.zeros((2, x.shape[1]))
        if not self.car or x.shape[1] <= 4:
            return self._plain(x)
        keep = np.array([self.keep_mean, self.keep])
        for t in range(len(x)):
            v = x[t]
            if self.car and len(v) > 4:
                q = self.sums[1]
                v = v - (v[q > q.max() / 1e3].mean() if q.any() else v.mean())
            self.counts, self.sums = keep * self.counts + 1, keep[:, None] * self.sums
            self.sums[0] += v
            self.sums[1] += np.square(v - self.sums[0] / self.counts[0])
            out[t] = self.power()
        return out


    def _plain(self, x: np.ndarray) -> np.ndarray:
        """The same without re-referencing: sums and counts are linear recursions, a stride of samples at a time."""
        if not len(x):
            return np.empty_like(x)
        mean, power = (blocks.Linear([[k]], [1.0], [k], 1.0) for k in (self.keep_mean, self.keep))
        ones = np.ones((len(x), 1))
        n, _ = mean.run(ones, self.counts[:1, None])
        m, _ = power.run(ones, self.counts[1:, None])
        sums, _ = mean.run(x, self.sums[:1])
        powers, _ = power.run(np.square(x - sums / n), self.sums[1:])
        self.counts, self.sums = np.array([n[-1, 0], m[-1, 0]]), np.stack([sums[-1], powers[-1]])
        return powers / m


def channel_power(df: DataFrame, keys: list[str], halflife: float, car: bool = True, mean_halflife: float | None = None, size: int = blocks.SIZE) -> DataFrame:
    """x becomes each channel's power by a PowerTracker that goes from block file to block file of a key."""

    def fn(rows, state):
        t = PowerTracker(halflife, mean_halflife, car, state)
        return t.run(rows[2]), t.flat()

    return blocks.in_sequence(df, keys, fn, size=size)


def whitener(c: np.ndarray, reg: float = 0.0, rcond: float = 1e-6, symmetric: bool = True) -> np.ndarray:
    """W with W' C W = I on the directions kept: C is shrunk to its median variance, eigenvalues under rcond of the median one go
    (rcond < 0: that share of them; above 1: that many are kept)."""
    c = (1 - reg) * c + reg * np.median(np.diag(c)) * np.eye(len(c))
    v, u = np.linalg.eigh((c + c.T) / 2)
    keep = v > max(rcond * np.median(np.abs(v)), 0)
    if rcond < 0:
        keep &= np.argsort(np.argsort(v)) >= int(-rcond * len(v))
    elif rcond >= 1:
        keep &= np.argsort(np.argsort(-v)) < int(rcond)
    scale = 1 / np.sqrt(v[keep])
    return u[:, keep] * scale @ u[:, keep].T if symmetric else u[:, keep] * scale


def spatial_whiten(df: DataFrame, groups: list[str], reg: float = 0.0) -> DataFrame:
    """x times the whitener of its group's covariance: d * d sums come to one task a group, the rows join them."""
    from pyspark.sql import functions as F

    from pulsegrid.operators.stats import cov_xx

    c = cov_xx(df, groups, centre=False, unit=True)
    kinds = dict(df.dtypes)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        d = int(f["d1"].max()) + 1
        m = np.zeros((d, d))
        m[f["d1"], f["d2"]] = f["v"]
        return pd.DataFrame({**{g: [f[g].iloc[0]] for g in groups}, "_w": [whitener(m, reg).T.tolist()]})

    w = c.groupBy(*groups).applyInPandas(fit, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", _w array<array<double>>")
    dot = F.transform("_w", lambda row: F.aggregate(F.zip_with(row, "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return df.join(cut(w, "whiteners"), groups).withColumn("x", dot).select(*df.columns)


def spectral_whiten(df: DataFrame, groups: list[str], trial: str = "trial", reg: float = 0.01) -> DataFrame:
    """Each trial's spectrum times 1 / (H + max(H) reg), H the group's mean amplitude by frequency and channel. A trial is one row; H is one row a
    group and length of trials, which joins the trials, not their samples."""
    from pyspark.sql import functions as F

    keys = [*groups, trial]
    t = cut(blocks.to_blocks(df, keys, None).withColumn("n", F.size("rows").cast("bigint")), "trials")

    def amplitude(rows, _):
        a = np.abs(np.fft.fft(rows[2], axis=0))
        return {"n": len(a), "a": a.T.ravel().tolist()}

    h = blocks._map(t, keys, "n bigint, a array<double>", amplitude).select(*groups, "n", F.posexplode("a").alias("k", "a")).groupBy(*groups, "n", "k").agg(F.avg("a").alias("a"))
    h = h.groupBy(*groups, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "a"))), lambda r: r["a"]).alias("state"))  # channels times frequencies of one trial length

    def whiten(rows, state):
        x = rows[2]
        w = state[: x.size].reshape(x.shape[1], -1).T
        return {"_r": blocks._packed(rows[0], rows[1], np.real(np.fft.ifft(np.fft.fft(x, axis=0) / (w + w.max() * reg), axis=0)))}

    return blocks._rows(blocks._map(t.join(cut(h, "amplitudes"), [*groups, "n"]), keys, blocks.ROW, whiten), df, keys, None)


def envelope(df: DataFrame, keys: list[str], fs: float, stop: list | None = None, whiten: list[str] | None = None, bands: list[tuple[float, float]] | None = None, log: bool = True, env_stop=(10, -1)) -> DataFrame:
    """Filter (stop), whiten by the covariance of the groups in `whiten`, split into bands (each band of each channel becomes a
    channel), absolute value, log of at least 1e-6, and filter again (env_stop, a low-pass)."""
    if stop is not None:
        df = iir_filter(df, keys, fs, [stop])
    if whiten:
        df = spatial_whiten(df, whiten)
    if bands:
        df = iir_filterbank(df, keys, fs, bands)
    from pyspark.sql import functions as F

    flat = lambda v: F.log(F.greatest(F.abs(v), F.lit(1e-6))) if log else F.abs(v)
    df = df.withColumn("x", F.transform("x", flat))
    return iir_filter(df, keys, fs, [env_stop]) if env_stop is not None else df


def filter_downsample(df: DataFrame, keys: list[str], fs: float, bands: list, fs_out: float, order: int = 4) -> DataFrame:
    """The filters of iir_filter, then every r-th sample, r = fs / fs_out to the nearest half; half places lie between their
    neighbours."""
    from pyspark.sql import functions as F

    y = iir_filter(df, keys, fs, bands, order)
    twice = max(2, round(2 * fs / fs_out))
    w = Window.partitionBy(*keys).orderBy("samp")
    s = y.withColumn("_n", F.lead("x").over(w)).withColumn("_at", F.explode(F.array(2 * F.col("samp"), 2 * F.col("samp") + 1))).where(F.col("_at") % twice == 0)
    half = F.col("_at") % 2 == 1
    s = s.where(~half | F.col("_n").isNotNull()).withColumn("x", F.when(half, F.zip_with("x", "_n", lambda a, b: (a + b) / 2)).otherwise(F.col("x")))
    return s.withColumn("samp", (F.col("_at") / twice).cast("bigint")).select(*df.columns)


def average_spectrum(df: DataFrame, groups: list[str], trial: str, fs: float, segment: int, log: bool = False) -> DataFrame:
    """groups, ch, freq, p: Welch power of each trial, the median over trials."""
    from pyspark.sql import functions as F

    kinds = dict(df.dtypes)
    ship(df.sparkSession)

    def welch(f: pd.DataFrame) -> pd.DataFrame:
        x = np.array(f.sort_values("samp")["x"].tolist(), float)
        n = min(segment, len(x))
        w = np.hanning(n + 1)[:n] if n > 1 else np.ones(1)
        parts = [np.abs(np.fft.rfft((x[k : k + n] - x[k : k + n].mean(0)) * w[:, None], axis=0)) ** 2 for k in range(0, len(x) - n + 1, max(1, n // 2))]
        p = np.mean(parts, axis=0) / (fs * (w * w).sum())
        p[1 : (n + 1) // 2] *= 2
        k, c = np.indices(p.shape)
        return pd.DataFrame({**{g: f[g].iloc[0] for g in groups}, "ch": c.ravel(), "freq": np.fft.rfftfreq(n, 1 / fs)[k.ravel()], "p": p.ravel()})

    s = df.groupBy(*groups, trial).applyInPandas(welch, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", ch int, freq double, p double")
    p = F.percentile("p", F.lit(0.5))
    return s.groupBy(*groups, "ch", "freq").agg((10 * F.log10(p) if log else p).alias("p"))
