"""Trials, epochs and the joins of stimulus with samples. Times are long ms; keys are lists of column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import deal

def _w(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def trials_from_markers(markers: DataFrame, keys: list[str], tie: str = "seq") -> DataFrame:
    """keys, segment, trial, bgn, end. A NEWTARGET opens, every marker after it closes and opens, a MODECHANGE closes the
    last one and ends the segment."""
    w = _w(keys, "ts", tie)
    m = markers.withColumn("segment", F.coalesce(F.sum((F.col("kind") == "MODECHANGE").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = _w([*keys, "segment"], "ts", tie)
    m = m.withColumn("_open", F.max((F.col("kind") == "NEWTARGET").cast("int")).over(_so_far(s))).withColumn("end", F.lead("ts").over(s))
    t = m.where("_open = 1 and kind <> 'MODECHANGE' and end is not null")
    return t.withColumn("trial", F.row_number().over(s)).select(*keys, "segment", "trial", F.col("ts").alias("bgn"), "end")


def trials_from_gaps(stimuli: DataFrame, bounds: DataFrame, keys: list[str], iti: int = 1000, keep: float = 0.2) -> DataFrame:
    """keys, bgn, dur, length: trials start at a stimulus after a gap of more than iti and count only if a gap follows.
    bounds: first_ts and last_ts (the last but one) of the samples. length: the 90th percentile of the durations."""
    p = stimuli.select(*keys, "ts", F.lit(1).alias("is_stim")).union(bounds.select(*keys, F.col("first_ts").alias("ts"), F.lit(0))).union(bounds.select(*keys, F.col("last_ts").alias("ts"), F.lit(2)))
    w = _w(keys, "ts", "is_stim")
    p = p.withColumn("_prev", F.lag("ts").over(w)).withColumn("_gap", F.coalesce((F.col("ts") - F.col("_prev") > iti).cast("int"), F.lit(0)))
    p = p.withColumn("_no", F.sum("_gap").over(_so_far(w)))
    t = p.groupBy(*keys, "_no").agg(F.min("ts").alias("bgn"), F.max("ts").alias("last"), F.max(F.when(F.col("_gap") == 1, F.col("is_stim"))).alias("kind"))
    t = t.withColumn("_after", F.max("_no").over(Window.partitionBy(*keys))).where((F.col("_no") > 0) & (F.col("_no") < F.col("_after")) & (F.col("kind") == 1))
    t = t.withColumn("dur", F.col("last") - F.col("bgn"))
    length = t.groupBy(*keys).agg(F.percentile("dur", F.lit(0.9)).alias("length"))
    return t.join(length, keys).where(F.col("dur") > keep * F.col("length")).select(*keys, "bgn", "dur", "length")


def epochs_from_gaps(events: DataFrame, keys: list[str], iti: int) -> DataFrame:
    """events + trial (from 0) and epoch (from 0 in its trial): a gap of more than iti samples starts a trial."""
    w = _w(keys, "samp")
    e = events.withColumn("_gap", F.coalesce((F.col("samp") - F.lag("samp").over(w) > iti).cast("int"), F.lit(0)))
    e = e.withColumn("trial", F.sum("_gap").over(_so_far(w)))
    return e.withColumn("epoch", F.row_number().over(_w([*keys, "trial"], "samp")) - 1).drop("_gap")


def trials_from_label_change(samples: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """keys, bgn (sample of the rise), label of the next sample, length (the largest gap between starts)."""
    w = _w(keys, "samp")
    s = samples.withColumn("_up", F.col(label) > F.lag(label).over(w)).withColumn("_next", F.lead(label).over(w))
    t = s.where("_up").select(*keys, F.col("samp").alias("bgn"), F.col("_next").alias("label"))
    t = t.withColumn("_gap", F.lead("bgn").over(_w(keys, "bgn")) - F.col("bgn"))
    return t.withColumn("length", F.max("_gap").over(Window.partitionBy(*keys))).drop("_gap")


#: Samples of one bucket of time that meet a segment as one row.
CHUNK = 128


def slice_segments(samples: DataFrame, segments: DataFrame, keys: list[str], width: int = 60_000) -> DataFrame:
    """The samples of each segment (keys, segment id columns, bgn, end): bgn <= ts < end, and the last one before bgn (of one
    time the greatest row). A range join by buckets of time: segments are repeated for their buckets, samples stand in one and
    meet a segment as chunks of at most CHUNK in order of time, so what is joined is a chunk, not a pair."""
    cols, names = ([c for c in x.columns if c not in keys] for x in (samples, segments))
    bucket = lambda t: F.floor(F.col(t) / width)
    s = samples.where(" and ".join(f"`{c}` is not null" for c in [*keys, "ts"])).withColumn("_bucket", bucket("ts"))
    b = deal(segments.withColumn("_bucket", F.explode(F.sequence(bucket("bgn"), F.floor(F.greatest(F.col("end") - 1, F.col("bgn")) / width)))), [*keys, "_bucket"])
    c = deal(s, [*keys, "_bucket"]).withColumn("_chunk", F.floor((F.row_number().over(_w([*keys, "_bucket"], "ts")) - 1) / CHUNK))
    c = c.groupBy(*keys, "_bucket", "_chunk").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.collect_list(F.struct(*cols)).alias("_rows"))
    inside = b.join(c, [*keys, "_bucket"]).where("_last >= bgn and _first < end").select(*keys, *names, F.inline("_rows")).where("ts >= bgn and ts < end")
    # the sample before: the last of the buckets before stands in front of its bucket; an as-of join by a union in order of time
    one = s.select(*keys, "_bucket", F.col("ts").alias("_t"), F.lit(1).alias("_side"), F.struct("ts", *[x for x in cols if x != "ts"]).alias("_s"), *[F.lit(None).cast(segments.schema[x].dataType).alias(x) for x in names])
    two = segments.select(*keys, bucket("bgn").alias("_bucket"), F.col("bgn").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_s"].dataType).alias("_s"), *names)
    held = one.select(*keys, "_bucket", "_s").union(two.select(*keys, "_bucket", "_s")).groupBy(*keys, "_bucket").agg(F.max("_s").alias("_s"))
    held = held.withColumn("_s", F.max("_s").over(_w(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1))).where("_s is not null")  # a row a bucket
    front = held.select(*keys, "_bucket", F.col("_s.ts").alias("_t"), F.lit(1).alias("_side"), "_s", *[F.lit(None).cast(segments.schema[x].dataType).alias(x) for x in names])
    u = one.union(two).union(front).withColumn("_s", F.max("_s").over(_so_far(_w([*keys, "_bucket"], "_t", "_side"))))
    before = u.where("_side = 0 and _s is not null and _s.ts < end").select(*keys, "_s.*", *names)
    return inside.select(*keys, *cols, *names).union(before.select(*keys, *cols, *names))


def slice_trials(samples: DataFrame, starts: DataFrame, keys: list[str], length: int, before: int = 0, after: int = 0, columns: list[str] | None = None) -> DataFrame:
    """keys, trial, samp (0..), columns: the window start + before .. start + length + after - 1; missing samples are 0."""
    columns = columns or ["v"]
    grid = starts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length + after - before - 1)))).withColumn("_at", F.col("start") + before + F.col("_k"))
    s = samples.select(*keys, F.col("samp").alias("_at"), *columns)
    j = grid.join(s, [*keys, "_at"], "left")
    return j.select(*keys, "trial", F.col("_k").alias("samp"), *[F.coalesce(F.col(c), F.lit(0).cast(samples.schema[c].dataType)).alias(c) for c in columns])


def fit_trial_length(samples: DataFrame, keys: list[str], trial: str = "trial", columns: list[str] | None = None, least: int = 0) -> DataFrame:
    """All trials at the 75th percentile of their sample counts: trials of at most half of it (or `least`) go, long ones are
    cropped, short ones hold their last value."""
    columns = columns or ["v"]
    n = samples.groupBy(*keys, trial).agg(F.count("*").alias("_n"))
    common = n.groupBy(*keys).agg(F.floor(F.percentile("_n", F.lit(0.75))).cast("int").alias("_len"))
    good = n.join(common, keys).where((F.col("_n") * 2 > F.col("_len")) & (F.col("_n") > least)).select(*keys, trial, "_len")
    grid = good.withColumn("samp", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)))
    order = _w([*keys, trial], "samp")
    s = samples.withColumn("samp", F.row_number().over(order) - 1)
    j = grid.join(s.select(*keys, trial, "samp", *columns), [*keys, trial, "samp"], "left")
    return j.select(*keys, trial, "samp", *[F.last(c, ignorenulls=True).over(_so_far(order)).alias(c) for c in columns])


def hold_state(events: DataFrame, keys: list[str], resets: DataFrame | None = None) -> DataFrame:
    """keys, ts, obj, state: the full state at each event time. Unreported objects hold their state, objects not seen yet
    are 0, only objects that are used at all are kept; resets (keys, ts) set all to 0."""
    e = events.groupBy(*keys, "ts", "obj").agg(F.max_by("state", "event_id").alias("state")) if "event_id" in events.columns else events.select(*keys, "ts", "obj", "state")
    used = e.select(*keys, "obj").distinct()
    grid = e.select(*keys, "ts").distinct().join(used, keys)
    g = grid.join(e, [*keys, "ts", "obj"], "left").withColumn("_reset", F.lit(0))
    if resets is not None:
        r = resets.select(*keys, "ts").distinct().join(used, keys).select(*keys, "ts", "obj", F.lit(None).cast("int").alias("state"), F.lit(1).alias("_reset"))
        g = g.select(*keys, "ts", "obj", "state", "_reset").union(r)
    order = F.col("ts"), F.col("_reset").desc()
    g = g.withColumn("_era", F.sum("_reset").over(_so_far(_w([*keys, "obj"], *order))))
    held = F.coalesce(F.last("state", ignorenulls=True).over(_so_far(_w([*keys, "obj", "_era"], "ts"))), F.lit(0))
    return g.withColumn("state", held).where("_reset = 0").select(*keys, "ts", "obj", "state")


def as_of_sample(samples: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """events + samp: the last sample with ts <= the event's (the first sample if there is none)."""
    cols = [c for c in events.columns if c not in (*keys, "ts")]
    one = samples.select(*keys, "ts", F.lit(0).alias("_side"), "samp", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols])
    two = events.select(*keys, "ts", F.lit(1).alias("_side"), F.lit(None).cast(samples.schema["samp"].dataType).alias("samp"), *cols)
    u = one.union(two).withColumn("samp", F.coalesce(F.last("samp", ignorenulls=True).over(_so_far(_w(keys, "ts", "_side"))), F.min("samp").over(Window.partitionBy(*keys))))
    return u.where("_side = 1 and samp is not null").drop("_side")


def upsample_stimulus(samples: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, obj, level: each state (keys, ts, obj, state) goes to its as-of sample and is held until just before the
    next; 0 before the first and after the last stimulus. Of stimuli that meet in one sample the later wins."""
    at = as_of_sample(samples, states, keys).groupBy(*keys, "samp", "obj").agg(F.max_by("state", "ts").alias("state"))
    return _hold(samples, at, keys)


def _hold(samples: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    ends = at.groupBy(*keys).agg(F.max("samp").alias("_last"))
    objects = at.select(*keys, "obj").distinct()
    g = samples.select(*keys, "samp").join(objects, keys).join(at, [*keys, "samp", "obj"], "left").join(ends, keys)
    level = F.when(F.col("samp") <= F.col("_last"), F.coalesce(F.last("state", ignorenulls=True).over(_so_far(_w([*keys, "obj"], "samp"))), F.lit(0))).otherwise(0)
    return g.select(*keys, "samp", "obj", level.alias("level"))


def nearest_sample(samples: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """events + samp: the sample of least time difference, the lower one on ties."""
    s = samples.withColumn("_next", F.lead(F.struct("ts", "samp")).over(_w(keys, "ts", "samp")))
    one = s.select(*keys, "ts", "samp", "_next")
    cols = [c for c in events.columns if c not in (*keys, "ts")]
    left = one.select(*keys, "ts", F.lit(0).alias("_side"), F.struct(F.col("ts").alias("ts"), F.col("samp").alias("samp"), F.col("_next").alias("next")).alias("_s"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols])
    right = events.select(*keys, "ts", F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), *cols)
    u = left.union(right).withColumn("_s", F.last("_s", ignorenulls=True).over(_so_far(_w(keys, "ts", "_side"))))
    u = u.withColumn("_first", F.min("_s.samp").over(Window.partitionBy(*keys)))
    near = F.when(F.col("_s").isNull(), F.col("_first")).when(F.col("_s.next").isNotNull() & (F.col("_s.next.ts") - F.col("ts") < F.col("ts") - F.col("_s.ts")), F.col("_s.next.samp")).otherwise(F.col("_s.samp"))
    return u.where("_side = 1").withColumn("samp", near).where("samp is not null").select(*keys, "ts", "samp", *cols)


def epoch_slices(samples: DataFrame, events: DataFrame, keys: list[str], tau: int, columns: list[str]) -> DataFrame:
    """events x lags 0..tau-1 with the columns of sample samp + lag."""
    e = events.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(tau - 1)))).withColumn("_at", F.col("samp") + F.col("lag"))
    return e.join(samples.select(*keys, F.col("samp").alias("_at"), *columns), [*keys, "_at"]).drop("_at")


def sliding_windows(samples: DataFrame, keys: list[str], size: int, step: int, value: str = "v") -> DataFrame:
    """keys, samp (start), win (array of size values): full windows, every step samples."""
    w = _w(keys, "samp").rowsBetween(0, size - 1)
    return samples.withColumn("win", F.collect_list(value).over(w)).where((F.size("win") == size) & (F.col("samp") % step == 0)).select(*keys, "samp", "win")


def subtrials(samples: DataFrame, keys: list[str], fs: float, seconds: float, trial: str = "trial") -> DataFrame:
    """samples + sub, cut into windows of floor(n / (n / fs / seconds)) samples; the rest is dropped."""
    n = F.count("*").over(Window.partitionBy(*keys, trial))
    size = F.floor(n / F.greatest(F.floor(n / fs / seconds), F.lit(1))).cast("int")
    s = samples.withColumn("_size", size).withColumn("_n", n).withColumn("sub", F.floor(F.col("samp") / F.col("_size")).cast("int"))
    return s.where((F.col("sub") + 1) * F.col("_size") <= F.col("_n")).withColumn("samp", (F.col("samp") % F.col("_size")).cast("int")).drop("_size", "_n")


def trim_to_range(samples: DataFrame, stimuli: DataFrame, keys: list[str], margin: int = 1000) -> DataFrame:
    r = stimuli.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return samples.join(r, keys).where((F.col("ts") >= F.col("_a") - margin) & (F.col("ts") <= F.col("_b") + margin)).drop("_a", "_b")


def join_codebook(samples: DataFrame, codebook: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """keys, samp, obj, level: code of sample s is row s modulo the code's length; object 0 repeats the target's code.
    codebook: event_idx, obj, level; samples: keys, samp, target (an object of the codebook)."""
    n = codebook.agg((F.max("event_idx") + 1).alias("_n"))
    s = samples.select(*keys, "samp", target).join(F.broadcast(n)).withColumn("event_idx", F.col("samp") % F.col("_n"))
    j = s.join(codebook.select("event_idx", "obj", "level"), "event_idx")
    return j.select(*keys, "samp", (F.col("obj") + 1).alias("obj"), "level").union(j.where(F.col("obj") == F.col(target)).select(*keys, "samp", F.lit(0).cast("bigint"), "level"))


def label_indicator(rows: DataFrame, label: str, classes: dict[str, list]) -> DataFrame:
    """rows x classes with 0/1: a class is a group of labels."""
    c = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(label).isin(v).cast("int").alias("v")) for k, v in classes.items()]))
    return rows.select(*rows.columns, c.alias("_c")).select(*rows.columns, "_c.cls", "_c.v")


def stim_at_rate_indicator(samples: DataFrame, triggers: DataFrame, keys: list[str], labels: list[str], samp: str = "samp", value: str = "value") -> DataFrame:
    """keys, samp and one column of 0 and 1 for each label: the labelled triggers on their sample; samples without one are 0."""
    t = triggers.groupBy(*keys, samp).agg(*[F.max((F.col(value) == x).cast("int")).alias(x) for x in labels])
    j = samples.select(*keys, samp).join(t, [*keys, samp], "left")
    return j.select(*keys, samp, *[F.coalesce(x, F.lit(0)).alias(x) for x in labels])


def upsample_codebook(epochs: DataFrame, keys: list[str], duration: int, length: int, offset: int = 0) -> DataFrame:
    """keys, samp, obj, level: each epoch's level is held for duration samples from its start; later epochs win."""
    e = epochs.withColumn("_from", F.col("samp") + offset).withColumn("at", F.explode(F.sequence(F.col("_from"), F.col("_from") + duration - 1)))
    return e.where((F.col("at") >= 0) & (F.col("at") < length)).groupBy(*keys, F.col("at").alias("samp"), "obj").agg(F.max_by("level", "_from").alias("level"))


def stack_streams(streams: DataFrame, attended: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samp, obj, v: object 0 is the attended stream, 1.. all streams, cut to the common length."""
    n = streams.groupBy(*keys, "stream").agg(F.max("samp").alias("_m")).groupBy(*keys).agg(F.min("_m").alias("_m"))
    s = streams.join(n, keys).where("samp <= _m")
    first = s.join(attended, keys).where(F.col("stream") == F.col("attended")).select(*keys, "samp", F.lit(0).cast("bigint").alias("obj"), "v")
    return first.union(s.select(*keys, "samp", (F.col("stream") + 1).cast("bigint").alias("obj"), "v"))


def virtual_outputs(stim: DataFrame, keys: list[str], n: int, block: int, seed: int = 0) -> DataFrame:
    """stim + n decoy objects (1000, 1001, ...): each block of time shows another block of an object of the same key, never
    its own place; which one is told by a hash of (seed, decoy, block)."""
    s = stim.withColumn("_blk", F.floor(F.col("samp") / block)).withColumn("_off", F.col("samp") % block)
    size = s.groupBy(*keys).agg((F.max("_blk") + 1).alias("_n"), F.sort_array(F.collect_set("obj")).alias("_objs")).where("_n > 1")  # objects of one key: a fixed few
    g = size.select(*keys, "_n", "_objs", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_to")).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_perm").cast("string"), F.col("_to").cast("string"))), 1, 12), 16, 10).cast("bigint")
    g = g.withColumn("_blk", F.pmod(F.col("_to") + 1 + F.pmod(h, F.col("_n") - 1), F.col("_n"))).withColumn("obj", F.element_at("_objs", (F.pmod(F.shiftright(h, 8), F.size("_objs")) + 1).cast("int")))
    d = g.join(s, [*keys, "_blk", "obj"]).select(*keys, (F.col("_to") * block + F.col("_off")).cast("bigint").alias("samp"), (F.col("_perm") + 1000).cast("bigint").alias("obj"), "level")
    return stim.select(*keys, F.col("samp").cast("bigint"), F.col("obj").cast("bigint"), "level").union(d)


def reference_signals(n: int, fs: float, freqs: DataFrame, binary: bool = False) -> DataFrame:
    """samp, obj, v: sin(2 pi (samp freq / fs + phase)) of each (obj, freq, phase)."""
    import math

    s = freqs.withColumn("samp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    v = F.sin(2 * math.pi * (F.col("samp") * F.col("freq") / fs + F.col("phase")))
    return s.select("samp", "obj", ((v > 0).cast("double") if binary else v).alias("v"))


def electrode_positions(channels: DataFrame, cap: DataFrame, prefix: bool = False, tie: str | None = None) -> DataFrame:
    """channels (ch, name) + x2 y2 x3 y3 z3 iseeg; names without an electrode get (-1, 1), (-1, 1, 0), false. prefix: the longest electrode that a
    name begins with; of electrodes of one name the one of the largest `tie`."""
    c = cap.select(F.lower("name").alias("_n"), "x2", "y2", "x3", "y3", "z3", *([F.col(tie).alias("_t")] if tie else []))
    name = F.lower(F.col("name"))
    if prefix:  # beginnings as long as some electrode's name are looked up; positions join the one electrode found
        order = F.struct(*(["_t"] if tie else []), "x2", "y2", "x3", "y3", "z3")
        c = c.groupBy("_n").agg(F.max(order).alias("_c")).select("_n", "_c.x2", "_c.y2", "_c.x3", "_c.y3", "_c.z3")
        lengths = c.select(F.length("_n").alias("_k")).where("_k > 0").distinct().agg(F.array_sort(F.collect_set("_k")).alias("_ks"))  # as many as names have lengths
        heads = channels.select("ch", name.alias("_name")).crossJoin(lengths).select("ch", F.explode(F.transform(F.filter("_ks", lambda k: k <= F.length("_name")), lambda k: F.substring(F.col("_name"), F.lit(1), k))).alias("_h"))
        found = heads.join(c.select("_n").hint("shuffle_hash"), F.col("_h") == F.col("_n")).groupBy("ch").agg(F.max(F.length("_n")).alias("_long"))
        own = channels.join(found.hint("merge"), "ch", "left").withColumn("_h", F.substring(name, F.lit(1), F.col("_long")))
        j = own.join(c.hint("merge"), F.col("_h") == F.col("_n"), "left")
    else:
        j = channels.join(c, name == F.col("_n"), "left")
    fill = {"x2": -1.0, "y2": 1.0, "x3": -1.0, "y3": 1.0, "z3": 0.0}
    return j.select(*channels.columns, *[F.coalesce(k, F.lit(v)).alias(k) for k, v in fill.items()], F.col("_n").isNotNull().alias("iseeg"))


def drop_unused_outputs(stim: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    used = stim.groupBy(*keys, "obj").agg(F.max((F.col(level) != 0).cast("int")).alias("_u")).where("_u = 1 or obj = 0").drop("_u")
    return stim.join(used, [*keys, "obj"], "left_semi")


def merge_prior_sessions(now: DataFrame, prior: DataFrame, x: str = "x") -> DataFrame:
    """The union with an earlier set if both have the same number of channels."""
    a, b = (d.agg(F.max(F.size(x))).first()[0] for d in (now, prior))
    return now.unionByName(prior) if a == b else now


def limit_outputs(stim: DataFrame, n: int) -> DataFrame:
    return stim.where(F.col("obj") <= n)
