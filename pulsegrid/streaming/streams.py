"""On-line twins of the batch operators on Structured Streaming. Event time is `time` (timestamp); `ts` is long ms.

Rows later than the watermark are dropped. Stateful steps keep per-key state that is bounded: the last levels of a key, the
state of a filter, the running powers. Steps by trial take idle_ms: the state of a trial that gets nothing for so long goes (a
replay of recorded data leaves it out, since Spark then runs batches without end). Rows of a key are taken in their
order within a batch; a batch that comes later is taken as later.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.filters import PowerTracker
from pulsegrid.operators.blocks import Linear
from pulsegrid.shared import ship
from pulsegrid.sources.logs import parse_log


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Recorded logs replayed as a stream of messages with event time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("session"), "value")
    return parse_log(lines).withColumn("time", F.timestamp_millis("ts"))


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table (a folder, or one file of a folder) as a stream of its files."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    top, _, name = path.rstrip("/").rpartition("/")
    one_file = spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(f"/{name}")
    return r.option("pathGlobFilter", name).parquet(top) if one_file else r.parquet(path)


def message_filter(messages: DataFrame, types: list[str], always: tuple[str, ...] = ("HEARTBEAT",)) -> DataFrame:
    return messages.where(F.col("msg_type").isin([*types, *always]))


def stream_windows(events: DataFrame, keys: list[str], horizon: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """keys, start, end, n: counts over trailing windows."""
    g = events.withWatermark("time", late).groupBy(F.window("time", horizon, slide).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def _stateful(df: DataFrame, keys: list[str], out: str, state: str, fn: Callable, mode: str = "append", idle_ms: int | None = None) -> DataFrame:
    ship(df.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from fn(key, frames, state)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return df.groupBy(*keys).applyInPandasWithState(run, out, state, mode, GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def stream_code(levels: DataFrame, evt: str = "re", keep: int = 20) -> DataFrame:
    """session, obj, samp, v of levels(session, obj, samp, level): the pattern code of each new sample; the last `keep` levels
    of an object are its state."""
    from pulsegrid.operators.events import PATTERNS

    bits = PATTERNS.get(evt, evt)

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values("samp")
        whole = past + f["level"].tolist()
        out = []
        for i in range(len(past), len(whole)):
            tail = whole[max(0, i + 1 - len(bits)) : i + 1]
            out.append(int(len(tail) == len(bits) and all((v > 0) == (b == "1") for v, b in zip(tail, bits, strict=True))))
        state.update((whole[-keep:],))
        yield pd.DataFrame({"session": key[0], "obj": key[1], "samp": f["samp"].to_numpy(), "v": out})

    return _stateful(levels, ["session", "obj"], "session long, obj long, samp long, v int", "past array<int>", fn)


def stream_code_events(levels: DataFrame, evts: list[str], keys: tuple[str, ...] = ("session", "trial"), idle_ms: int | None = None) -> DataFrame:
    """keys, samp, obj, evt, v of levels(keys, samp, obj, level): operators.events.code_events on-line, for every event type it knows. All objects of a
    sample come in one batch. State of a key: the objects, how often each was active, and of each the last levels that the longest pattern looks at."""
    from pulsegrid.operators.events import PATTERNS

    base = {e: e[2:] if e.startswith("nt") else e[3:] if e.startswith("any") else e for e in evts}
    plain = list(dict.fromkeys(base.values()))
    bits = {e: PATTERNS.get(e, e) for e in plain if e not in ("1", "0", "flash", "raw", "grad", "diff", "onset", "rest")}
    if bad := [e for e, b in bits.items() if not b or set(b) - {"0", "1"}]:
        raise ValueError(f"unknown event types {bad}")
    keep = max([2, *(len(b) for b in bits.values())]) - 1

    def codes(past: np.ndarray, new: np.ndarray, active: int) -> dict[str, np.ndarray]:
        whole, n = np.concatenate([past, new]), len(new)
        before = lambda k: whole[max(0, len(past) - k) : len(whole) - k]  # noqa: E731  levels k samples ago, fewer at the begin
        late = lambda x: np.concatenate([np.zeros(n - len(x), x.dtype), x])  # noqa: E731  0 where there is none
        out = {}
        for e in plain:
            if e in bits:
                hit = np.ones(n, bool)
                for k, bit in enumerate(reversed(bits[e])):
                    hit &= late(before(k) > 0 if bit == "1" else before(k) == 0)
                out[e] = hit
            elif e in ("1", "flash", "0"):
                out[e] = new == (e != "0")
            elif e in ("grad", "diff"):
                step = late(new[n - len(before(1)) :] - before(1))
                out[e] = step if e == "grad" else step != 0
            elif e == "onset":
                out[e] = active + np.cumsum(new > 0) == 1
            else:
                out[e] = new
        return out

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        if state.exists:
            objs, active, flat, sizes = state.get
            cuts = np.cumsum([0, *sizes])
            held = {o: (n, np.array(flat[i:j], float)) for o, n, i, j in zip(objs, active, cuts, cuts[1:], strict=False)}
        f = pd.concat(list(frames)).sort_values(["obj", "samp"])
        parts = []
        for o, part in f.groupby("obj", sort=True):
            n, past = held.get(int(o), (0, np.zeros(0)))
            new = part["level"].to_numpy(float)
            parts.append(part[["samp", "obj"]].assign(**{f"c_{e}": np.asarray(v, float) for e, v in codes(past, new, n).items()}))
            held[int(o)] = n + int((new > 0).sum()), np.concatenate([past, new])[-keep:]
        d = pd.concat(parts)
        for e in plain:
            if e == "rest":
                d["c_rest"] = (d["c_rest"].abs().groupby(d["samp"]).transform("max") == 0).astype(float)
        rows = []
        for e in evts:
            v = d[f"c_{base[e]}"]
            if e != base[e]:
                some = v.groupby(d["samp"]).transform("max")
                v = ((v == 0) & (some == 1)).astype(float) if e.startswith("nt") else some
            rows.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), "samp": d["samp"], "obj": d["obj"], "evt": e, "v": v}))
        state.update(([*held], [n for n, _ in held.values()], [float(v) for _, p in held.values() for v in p], [len(p) for _, p in held.values()]))
        yield pd.concat(rows)

    kinds = dict(levels.dtypes)
    return _stateful(levels.select(*keys, "samp", "obj", "level"), list(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + f", samp {kinds['samp']}, obj {kinds['obj']}, evt string, v double", "objs array<long>, active array<long>, flat array<double>, sizes array<int>", fn, idle_ms=idle_ms)


def stream_hold_and_code(rows: DataFrame, evt: str = "re", keep: int = 20, idle_ms: int | None = None) -> DataFrame:
    """session, samp, obj, v of rows(session, samp, obj, level, reset): each sample carries the levels that changed (obj null: none
    did), other objects hold theirs; the code of every object met so far. A row with reset (a new target) forgets all
    levels before its sample. State: the objects and their last `keep` levels."""
    from pulsegrid.operators.events import PATTERNS

    bits = PATTERNS.get(evt, evt)

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, list[int]] = {}
        if state.exists:
            objs, flat, sizes = state.get
            at = 0
            for o, n in zip(objs, sizes, strict=True):
                held[o], at = list(flat[at : at + n]), at + n
        f = pd.concat(list(frames))
        f = f[f["samp"].notna()].sort_values("samp", kind="stable")
        samps, at = np.unique(f["samp"].to_numpy(np.int64), return_inverse=True)
        resets, told = np.zeros(len(samps), int), f["obj"].notna().to_numpy()
        resets[at[f["reset"].eq(True).to_numpy(bool)]] = 1
        obj, level, place = f["obj"].to_numpy()[told].astype(np.int64), f["level"].to_numpy()[told].astype(np.int64), at[told]
        parts = []
        for o in sorted(held.keys() | set(np.unique(obj).tolist())):  # its held levels, then a level a sample from its first change after a reset
            past, mine = held.pop(o, []), obj == o
            p, m = len(past), len(past) + len(samps)
            changed, value = np.concatenate([np.arange(p), p + place[mine]]), np.concatenate([np.array(past, np.int64), level[mine]])
            newest = np.append(changed[1:] != changed[:-1], True)  # of changes in one sample the last counts
            changed, value = changed[newest], value[newest]
            era, i = np.concatenate([np.zeros(p, int), np.cumsum(resets)]), np.arange(m)
            last = np.searchsorted(changed, i, "right") - 1
            alive = (last >= 0) & (era[changed[last]] == era)
            whole = value[last]
            begin = changed[np.minimum(np.searchsorted(era[changed], era), len(changed) - 1)]
            hit = alive & (i - begin + 1 >= len(bits)) & (len(bits) <= keep)
            for k, bit in enumerate(reversed(bits)):
                hit[k:] &= (whole[: m - k] > 0) == (bit == "1")
            new = alive[p:]
            parts.append(pd.DataFrame({"session": key[0], "samp": samps[new], "obj": o, "v": hit[p:][new].astype(np.int32)}))
            if alive[-1]:
                held[o] = whole[max(begin[-1], m - keep) :].tolist()
        state.update(([*held], [v for x in held.values() for v in x], [len(x) for x in held.values()]))
        if parts:
            yield pd.concat(parts).sort_values(["samp", "obj"])

    return _stateful(rows, ["session"], "session long, samp long, obj long, v int", "objs array<long>, flat array<int>, sizes array<int>", fn, idle_ms=idle_ms)


def stream_filter(signal: DataFrame, sos: np.ndarray, every: int = 1) -> DataFrame:
    """session, samp, x: filtered, then each every-th sample; filter state and sample count of a session carry over."""
    system = Linear.sections(sos)

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("samp")
        x = np.array(f["x"].tolist(), float)
        y, new = system.run(x, np.array(state.get[0]).reshape(-1, x.shape[1]) if state.exists else system.steady(x[0]))
        state.update((new.ravel().tolist(),))
        at = f["samp"].to_numpy() % every == 0
        yield pd.DataFrame({"session": key[0], "samp": f["samp"].to_numpy()[at] // every, "x": list(y[at])})

    return _stateful(signal, ["session"], "session long, samp long, x array<double>", "z array<double>", fn)


def stream_quality(signal: DataFrame, halflife: float = 100.0, interval_ms: int = 1000, system: Linear | None = None, mean_halflife: float | None = None, car: bool = True) -> DataFrame:
    """session, ts, raw, pre, noise (arrays by channel) of signal(session, samp, ts, x and, without a system, pre): decayed powers before and
    after cleaning, and the share that cleaning removed, at a session's first sample and then at the first one more than interval_ms of event time
    after the last report. A stream whose samples do not come in order of time has a column `due` that marks the samples to report at (quality_due tells
    them). system: a filter that cleans x here, channel by channel. State: both powers (each referenced to its active
    channels), the filter, and the time of the last report; so reports do not hang on where batches end."""
    marked = "due" in signal.columns

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, last = (None, None) if not state.exists else (np.array(state.get[0]), state.get[1])
        f = pd.concat(list(frames)).sort_values("samp")
        x = np.array(f["x"].tolist(), float)
        d = x.shape[1]
        if system:
            size = len(system.b) * d
            z = system.steady(x[0]) if flat is None else flat[:size].reshape(-1, d)
            y, z = system.run(x, z)
            rest, flat = z.ravel(), None if flat is None else flat[size:]
        else:
            y, rest = np.array(f["pre"].tolist(), float), np.zeros(0)
        half = 2 + 2 * d
        trackers = [PowerTracker(halflife, mean_halflife, car, None if flat is None else flat[k * half : (k + 1) * half]) for k in range(2)]
        powers = [t.run(v) for t, v in zip(trackers, (x, y), strict=True)]
        out = []
        due = f["due"].tolist() if marked else None
        for i, ts in enumerate(f["ts"].tolist()):
            if due[i] if marked else last is None or ts > last + interval_ms:
                last = int(ts)
                raw, pre = powers[0][i], powers[1][i]
                out.append((key[0], last, raw.tolist(), pre.tolist(), noise_to_signal(raw, pre).tolist()))
        state.update((np.concatenate([rest, *(t.flat() for t in trackers)]).tolist(), last))
        yield pd.DataFrame(out, columns=["session", "ts", "raw", "pre", "noise"])

    cols = ["session", "samp", "ts", "x", *([] if system else ["pre"]), *(["due"] if marked else [])]
    return _stateful(signal.select(*cols), ["session"], "session long, ts long, raw array<double>, pre array<double>, noise array<double>", "flat array<double>, last long", fn)


def quality_due(times: DataFrame, interval_ms: int) -> DataFrame:
    """session, samp: where reports are due when all of times(session, samp, ts) is known, in order of time: a session's least time, then again and again the
    least one more than interval_ms later; of samples of one time the first. A task walks over sorted rows and holds a batch of them."""
    ship(times.sparkSession)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, int] = {}
        for f in frames:
            for s, part in f.groupby("session", sort=False):
                ts, samp, at, found = part["ts"].to_numpy(), part["samp"].to_numpy(), 0, []
                if s in last:
                    at = int(np.searchsorted(ts, last[s] + interval_ms, "right"))
                while at < len(ts):
                    found.append(samp[at])
                    last[s] = int(ts[at])
                    at = int(np.searchsorted(ts, last[s] + interval_ms, "right"))
                yield pd.DataFrame({"session": s, "samp": found})

    t = times.where("session is not null and ts is not null").groupBy("session", "ts").agg(F.min("samp").alias("samp"))
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(n, "session").sortWithinPartitions("session", "ts").select("session", "ts", "samp").mapInPandas(walk, "session long, samp long")


def noise_to_signal(raw: np.ndarray, pre: np.ndarray) -> np.ndarray:
    """clean.noise_to_signal of powers that a task holds."""
    a, b = np.sqrt(np.maximum(raw, 1e-8)), np.sqrt(np.maximum(pre, 1e-8))
    return np.where((raw < 1e-6) | (b > 10 * a), 100.0, np.minimum(100.0, np.maximum(1e-6, np.abs(a - b)) / b))


def stream_align(stimuli: DataFrame, samples: DataFrame, overlap_ms: int, late: str = "60 seconds") -> DataFrame:
    """session, stim_ts, obj, samp: each stimulus with the samples up to overlap_ms after it, once both sides have come. Samples are
    held by session and stretch of time, a quarter of the overlap each, and a stimulus stands in the stretches it reaches, so a row meets few that it does
    not pair with."""
    width = max(overlap_ms * 1000 // 4, 1)
    stretch = lambda time, more=0: F.expr(f"floor((unix_micros({time}) + {more}) / {width})")
    reached = F.explode(F.sequence(stretch("time"), stretch("time", overlap_ms * 1000)))
    a = stimuli.select(F.col("session").alias("_s"), F.col("time").alias("_at"), F.col("ts").alias("stim_ts"), "obj", reached.alias("_to")).withWatermark("_at", late)
    b = samples.select("session", "time", "samp", stretch("time").alias("_in")).withWatermark("time", late)
    on = (F.col("_s") == F.col("session")) & (F.col("_to") == F.col("_in")) & (F.col("time") >= F.col("_at")) & (F.col("time") <= F.col("_at") + F.expr(f"INTERVAL {overlap_ms} MILLISECONDS"))
    return a.join(b, on).select("session", "stim_ts", "obj", "samp")


def stream_predict(scores: DataFrame, keys: tuple[str, ...] = ("session", "trial"), idle_ms: int | None = None) -> DataFrame:
    """session, trial, samp, yest, margin: running sums of output scores(session, trial, samp, obj, v) of a trial; one row a
    sample and block. A new trial is a new key, so it starts from nothing."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        objs, sums = ([], []) if not state.exists else (list(state.get[0]), list(state.get[1]))
        total = dict(zip(objs, sums, strict=True))
        out = []
        for samp, part in pd.concat(list(frames)).groupby("samp", sort=True):
            for o, v in zip(part["obj"], part["v"], strict=True):
                total[int(o)] = total.get(int(o), 0.0) + float(v)
            order = sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))
            out.append((*key, int(samp), order[0][0], order[0][1] - (order[1][1] if len(order) > 1 else 0.0)))
        state.update(([*total], [*map(float, total.values())]))
        yield pd.DataFrame(out, columns=[*keys, "samp", "yest", "margin"])

    return _stateful(scores, list(keys), "session long, trial long, samp long, yest long, margin double", "objs array<long>, sums array<double>", fn, idle_ms=idle_ms)


def refit_decayed(stream: DataFrame, update: Callable[[DataFrame, DataFrame | None], DataFrame], fit: Callable[[DataFrame], DataFrame], at: str):
    """A stream writer that keeps statistics and the model of each batch under `at`: stats/batch=k is update(rows of batch k, the table of batch k - 1, or None),
    model/batch=k is fit of it. A batch that runs again reads what the one before left and writes the same tables over, so nothing counts twice. Batches that no
    later one needs may be deleted."""
    spark = stream.sparkSession

    def one(batch: DataFrame, k: int) -> None:
        old = spark.read.parquet(f"{at}/stats/batch={k - 1}") if k else None
        new = update(batch, old)
        new.write.mode("overwrite").parquet(f"{at}/stats/batch={k}")
        fit(spark.read.schema(new.schema).parquet(f"{at}/stats/batch={k}")).write.mode("overwrite").parquet(f"{at}/model/batch={k}")

    return stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(one)


def stream_score(rows: DataFrame, weights: dict[str, np.ndarray], mode: str = "block", limit: int = 2000, idle_ms: int | None = None) -> DataFrame:
    """Scores of the outputs by a full model while data come in. rows: session, trial, samp (counting up by one), x (array), stim (array of obj, evt, v:
    the events at the sample). weights: evt -> (lags, channels), all of one length tau.

    A sample is scored once its whole response has come, tau - 1 samples later; so batches leave neither gaps nor doubles, wherever
    they end. mode block: session, trial, samp, obj, v of every scored sample with events. mode trial: after each batch the trial so far is scored anew,
    its last `limit` samples at most: v is the sum over them, samp the last sample scored. State of a trial: the samples that
    still count, and their events. A new trial is a new key, so it starts from nothing."""
    evts = sorted(weights)
    w = np.stack([np.asarray(weights[e], float) for e in evts])  # the size of a model
    tau = w.shape[1]
    code = {e: i for i, e in enumerate(evts)}

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("samp")
        x = np.array(f["x"].tolist(), float)
        stim = [(int(t), int(e["obj"]), code[e["evt"]], float(e["v"])) for t, events in zip(f["samp"], f["stim"], strict=True) if events is not None for e in events if e["evt"] in code and e["v"]]
        first = int(f["samp"].iloc[0])
        if state.exists:
            first, flat, at, objs, kinds, values = state.get
            x = np.concatenate([np.array(flat, float).reshape(-1, x.shape[1]), x])
            stim = [*zip(at, objs, kinds, values, strict=True), *stim]
        n = max(0, len(x) - tau + 1)  # samples whose response is whole
        out = []
        if n:
            windows = np.lib.stride_tricks.sliding_window_view(x, tau, axis=0)  # sample, channel, lag
            low = max(0, n - limit) if mode == "trial" else 0
            score = np.einsum("ncl,elc->ne", windows[low:n], w, optimize=True)
            sums: dict[tuple, float] = {}
            for t, o, e, v in stim:
                if first + low <= t < first + n:
                    k = (t if mode == "block" else first + n - 1, o)
                    sums[k] = sums.get(k, 0.0) + v * score[t - first - low, e]
            out = [(*key, t, o, v) for (t, o), v in sorted(sums.items())]
        drop = n if mode == "block" else max(0, n - limit)
        stim = [s for s in stim if s[0] >= first + drop]
        state.update((first + drop, x[drop:].ravel().tolist(), *([s[k] for s in stim] for k in range(4))))
        yield pd.DataFrame(out, columns=["session", "trial", "samp", "obj", "v"])

    return _stateful(rows.select("session", "trial", "samp", "x", "stim"), ["session", "trial"], "session long, trial long, samp long, obj long, v double", "first long, flat array<double>, at array<long>, objs array<long>, kinds array<long>, values array<double>", fn, idle_ms=idle_ms)


def stream_sums(products: DataFrame, by: list[str]) -> DataFrame:
    """Additive statistics of a stream of products (by, v): write in update or complete mode."""
    return products.groupBy(*by).agg(F.sum("v").alias("v"), F.count("*").alias("n"))


def refit_each_batch(sums: DataFrame, fit: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands the whole statistics of each batch to a fit."""
    return sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(fit)


def stream_erp(aligned: DataFrame, samples: DataFrame | None = None, last: int = 600) -> DataFrame:
    """evt, lag, v, n over the last epochs of aligned rows (evt, epoch, lag, v): state is those epochs' values by lag."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values("epoch")
        held = (held + f["v"].tolist())[-last:]
        state.update((held,))
        yield pd.DataFrame({"evt": [key[0]], "lag": [key[1]], "v": [float(np.mean(held))], "n": [len(held)]})

    return _stateful(aligned, ["evt", "lag"], "evt string, lag long, v double, n long", "held array<double>", fn, "update")


def stream_epochs(stimuli: DataFrame, samples: DataFrame, tau: int, range_ms: tuple[int, int], last: int = 600, centre: bool = False) -> DataFrame:
    """session, evt, n, v (array of tau arrays by channel): the mean response over those of a session's newest `last` epochs that have the event. stimuli:
    session, ts, evt; samples: session, ts, x.

    An epoch waits in the state until a sample behind its end has come; it then holds the samples from ts + range_ms[0] to ts + range_ms[1], the first
    tau of them, a shorter one its last sample to the end. Epochs without a sample are left out. centre: less its first sample. Write in
    update mode. State of a session: waiting stimuli, the samples that they and coming ones may need (keep the watermark of the source in mind:
    samples older than the newest by more than the range's length go), and a ring of epochs."""
    before, after = range_ms
    both = stimuli.select("session", F.col("ts").cast("long").alias("ts"), "evt", F.lit(None).cast("array<double>").alias("x")).unionByName(samples.select("session", F.col("ts").cast("long").alias("ts"), F.lit(None).cast("string").alias("evt"), F.col("x").cast("array<double>").alias("x")))

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames))
        data = f[f["evt"].isna()].sort_values("ts", kind="stable")
        wait = f[f["evt"].notna()]
        wait = list(zip(wait["ts"].tolist(), wait["evt"].tolist(), strict=True))
        at, x = data["ts"].to_numpy(np.int64), np.array(data["x"].tolist(), float)
        ring_evt, ring = [], None
        if state.exists:
            w_ts, w_evt, h_at, h_x, ring_evt, flat, d = state.get
            wait += zip(w_ts, w_evt, strict=True)
            d = d or (x.shape[1] if len(data) else 0)
            old = np.array(h_x, float).reshape(-1, d) if d else np.zeros((0, 0))
            at = np.concatenate([np.array(h_at, np.int64), at])
            x = old if not len(data) else np.concatenate([old, x]) if len(old) else x
            order = np.argsort(at, kind="stable")
            at, x = at[order], x[order]
            ring_evt, ring = list(ring_evt), np.array(flat, float).reshape(-1, tau, d) if d else None
        d = x.shape[1] if len(at) else 0
        now = int(at[-1]) if len(at) else None
        ready = sorted(w for w in wait if now is not None and w[0] + after < now)
        wait = [w for w in wait if now is None or w[0] + after >= now]
        new, new_evt = [], []
        for ts, evt in ready:
            i, j = np.searchsorted(at, ts + before, "left"), np.searchsorted(at, ts + after, "right")
            if i < j:
                part = x[i : min(j, i + tau)]
                part = np.concatenate([part, np.repeat(part[-1:], tau - len(part), axis=0)])
                new.append(part - part[0] if centre else part)
                new_evt.append(evt)
        if new:
            ring = np.concatenate([ring, new]) if ring is not None and len(ring) else np.array(new)
            ring, ring_evt = ring[-last:], [*ring_evt, *new_evt][-last:]
            names = np.array(ring_evt)
            yield pd.DataFrame([(key[0], e, int((names == e).sum()), ring[names == e].mean(axis=0).tolist()) for e in sorted(set(ring_evt))], columns=["session", "evt", "n", "v"])
        if len(at):
            keep = at >= min([now - (after - before), *(ts + before for ts, _ in wait)])
            at, x = at[keep], x[keep]
        state.update(([t for t, _ in wait], [e for _, e in wait], at.tolist(), x.ravel().tolist(), ring_evt, ring.ravel().tolist() if ring is not None else [], d))

    return _stateful(both, ["session"], "session long, evt string, n long, v array<array<double>>", "w_ts array<long>, w_evt array<string>, h_at array<long>, h_x array<double>, ring_evt array<string>, ring array<double>, d int", fn, "update")


def press_release(predictions: DataFrame, keys: list[str], order: list[str], press: float = 0.1, release: float = 0.2) -> DataFrame:
    """predictions + fired: an error under `press` fires when not held; one over `release` lets go. What holds now is told by the
    newest row that crossed either threshold."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    cross = F.when(F.col("perr") < press, 1).when(F.col("perr") > release, 0)
    d = predictions.withColumn("_c", cross)
    held = F.coalesce(F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("fired", ((F.col("_c") == 1) & (held == 0)).cast("int")).withColumn("fired", F.coalesce("fired", F.lit(0))).drop("_c")


def stream_press_release(predictions: DataFrame, press: float = 0.1, release: float = 0.2) -> DataFrame:
    """session, ts, fired with one bit of state a session."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = bool(state.get[0]) if state.exists else False
        out = []
        for ts, perr in pd.concat(list(frames)).sort_values("ts")[["ts", "perr"]].itertuples(index=False):
            fired = perr < press and not held
            held = True if perr < press else False if perr > release else held
            out.append((key[0], int(ts), int(fired)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["session", "ts", "fired"])

    return _stateful(predictions, ["session"], "session long, ts long, fired int", "held boolean", fn)


def last_prediction(predictions: DataFrame, keys: list[str], order: str = "ts", threshold: float = 0.1) -> DataFrame:
    """keys, ts, yest, perr, sure: the newest prediction; on a stream in update mode."""
    g = predictions.groupBy(*keys).agg(F.max(F.struct(order, "yest", "perr")).alias("_p"))
    return g.select(*keys, f"_p.{order}", "_p.yest", "_p.perr", (F.col("_p.perr") < threshold).alias("sure"))


def clock_align_stream(messages: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """client, seq, aligned: client time plus the least server - client difference of sync messages in the trailing window. Each
    block first updates the clock, then stamps."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(zip(*state.get, strict=True)) if state.exists else deque()  # (time, difference), differences rise: the first is the least
        f = pd.concat(list(frames)).sort_values(["cts", "seq"])
        out = []
        for cts, sts, sync, seq in f[["cts", "sts", "sync", "seq"]].itertuples(index=False):
            if sync:
                while held and held[-1][1] >= sts - cts:
                    held.pop()
                held.append((int(cts), int(sts - cts)))
            while len(held) > 1 and held[0][0] <= cts - window_ms:
                held.popleft()
            out.append((key[0], int(seq), int(cts + (held[0][1] if held else 0))))
        state.update(([x for x, _ in held], [d for _, d in held]))
        yield pd.DataFrame(out, columns=["client", "seq", "aligned"])

    return _stateful(messages, ["client"], "client long, seq long, aligned long", "xs array<long>, ds array<long>", fn)


def stream_tracked_clock(messages: DataFrame, make: Callable[[np.ndarray | None], object]) -> DataFrame:
    """client, seq, aligned of messages(client, seq, x, y): each point first updates the client's tracker (ExpWeightedLine or LowerBoundLine of
    operators.clock; make(state or None) gives one), then is stamped by it. The tracker's flat state is all that is kept. Points of a batch are taken
    in order of seq."""

    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = make(np.array(state.get[0]) if state.exists else None)
        f = pd.concat(list(frames)).sort_values("seq")
        aligned = [t.step(float(a), float(b)) for a, b in zip(f["x"], f["y"], strict=True)]
        state.update((t.flat().tolist(),))
        yield pd.DataFrame({"client": key[0], "seq": f["seq"].to_numpy(), "aligned": aligned})

    return _stateful(messages.select("client", "seq", "x", "y"), ["client"], "client long, seq long, aligned double", "flat array<double>", fn)


def run_to_table(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows: a bounded replay for jobs and tests. In update mode the newest
    row of each key counts, in complete mode the last batch; a stream without rows gives an empty result."""
    import uuid

    from pyspark.sql.window import Window

    from pulsegrid.shared import shared_dir

    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    last = -1

    def keep(batch: DataFrame, k: int) -> None:
        nonlocal last
        last = k
        batch.write.mode("overwrite").parquet(f"{at}/rows/_batch={k}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if last < 0:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{at}/rows/_batch={last}")
    rows = None
    for k in range(last + 1):
        part = spark.read.schema(stream.schema).parquet(f"{at}/rows/_batch={k}").withColumn("_k", F.lit(k))
        rows = part if rows is None else rows.union(part)
    w = Window.partitionBy(*(keys or stream.columns[:1])).orderBy(F.desc("_k"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n")
