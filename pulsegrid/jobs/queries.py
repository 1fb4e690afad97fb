"""One query an operator over the given tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.jobs import evaluate
from pulsegrid.operators import clock, events, scores, segments, stats
from pulsegrid.sources import views
from pulsegrid.sources.views import with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__.removeprefix("q_")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# --- stimulus and samples on one time line: events of objects 0 and 1 are stimuli, the others mark samples


def sample_clock(spark, sf):
    from pyspark.sql.window import Window

    e = views.stim_events(spark, sf).where("obj >= 2")
    return e.select("session", "ts", (F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id")) - 1).alias("samp"))


def stimuli(spark, sf):
    return views.stim_events(spark, sf).where("obj < 2")


def levels(spark, sf):
    held = segments.hold_state(stimuli(spark, sf), ["session"])
    return segments.upsample_stimulus(sample_clock(spark, sf), held, ["session"])


LINE = with_views("stim_events") + """,
line AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS samp FROM stim_events WHERE obj >= 2),
stim AS (SELECT session, ts, obj, arg_max(state, event_id) AS state FROM stim_events WHERE obj < 2 GROUP BY ALL)"""
HELD = LINE + """,
grid AS (SELECT * FROM (SELECT DISTINCT session, ts FROM stim) JOIN (SELECT DISTINCT session, obj FROM stim) USING (session)),
held AS (SELECT session, ts, obj, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY session, obj ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS state FROM grid LEFT JOIN stim USING (session, ts, obj))"""
LEVELS = HELD + """,
seen_at AS (SELECT h.session, h.ts, h.obj, h.state, coalesce((SELECT max(samp) FROM line l WHERE l.session = h.session AND l.ts <= h.ts), (SELECT min(samp) FROM line l WHERE l.session = h.session)) AS samp FROM held h),
spot AS (SELECT session, samp, obj, arg_max(state, ts) AS state FROM seen_at WHERE samp IS NOT NULL GROUP BY ALL),
ends AS (SELECT session, max(samp) AS last FROM spot GROUP BY session),
levels AS (SELECT l.session, l.samp, o.obj, CASE WHEN l.samp <= e.last THEN coalesce(last_value(a.state IGNORE NULLS) OVER (PARTITION BY l.session, o.obj ORDER BY l.samp ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS level
  FROM line l JOIN (SELECT DISTINCT session, obj FROM spot) o ON o.session = l.session JOIN ends e ON e.session = l.session LEFT JOIN spot a ON a.session = l.session AND a.samp = l.samp AND a.obj = o.obj)"""


@query(HELD + " SELECT session, ts, obj, state FROM held")
def q_hold_state(spark, sf):
    return segments.hold_state(stimuli(spark, sf), ["session"])


@query(LEVELS + " SELECT session, samp, obj, level FROM levels")
def q_upsample_stimulus(spark, sf):
    return levels(spark, sf)


@query(LINE + """, near AS (SELECT s.session, s.ts, s.obj, l.samp, row_number() OVER (PARTITION BY s.session, s.ts, s.obj ORDER BY abs(l.ts - s.ts), l.samp) AS r FROM stim s JOIN line l ON l.session = s.session AND l.ts BETWEEN s.ts - 1000000000000 AND s.ts + 1000000000000)
SELECT session, ts, obj, samp FROM near WHERE r = 1""")
def q_nearest_sample(spark, sf):
    s = stimuli(spark, sf).groupBy("session", "ts", "obj").agg(F.max_by("state", "event_id").alias("state"))
    return segments.nearest_sample(sample_clock(spark, sf), s, ["session"]).select("session", "ts", "obj", "samp")


def pattern_sql(evt: str) -> str:
    bits = events.PATTERNS.get(evt, evt)
    terms = [f"{'level' if k == 0 else f'lag(level, {k}) OVER w'} {'> 0' if b == '1' else '= 0'}" for k, b in enumerate(reversed(bits))]
    return f"CAST(coalesce({' AND '.join(f'coalesce({t}, false)' for t in terms)}, false) AS INT)"


PLAIN = {
    "flash": "CAST(level = 1 AS INT)", "0": "CAST(level = 0 AS INT)", "re": pattern_sql("re"), "fe": pattern_sql("fe"), "11": pattern_sql("11"), "010": pattern_sql("010"), "0110": pattern_sql("0110"),
    "diff": "CAST(coalesce(level <> lag(level) OVER w, false) AS INT)", "grad": "coalesce(level - lag(level) OVER w, 0)", "raw": "level",
    "onset": "CAST(sum(CAST(level > 0 AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) = 1 AS INT)", "rest": "CAST(max(abs(level)) OVER (PARTITION BY session, samp) = 0 AS INT)",
}
CODED = LEVELS + f""",
coded AS (SELECT session, samp, obj, {', '.join(f'{s} AS "{k}"' for k, s in PLAIN.items())} FROM levels WINDOW w AS (PARTITION BY session, obj ORDER BY samp)),
more AS (SELECT *, CAST(re = 0 AND max(re) OVER (PARTITION BY session, samp) = 1 AS INT) AS ntre, max(re) OVER (PARTITION BY session, samp) AS anyre FROM coded)"""
ALL_EVENTS = [*PLAIN, "ntre", "anyre"]


@query(CODED + " SELECT session, samp, obj, evt, CAST(v AS DOUBLE) AS v FROM (" + " UNION ALL ".join(f"""SELECT session, samp, obj, '{e}' AS evt, "{e}" AS v FROM more""" for e in ALL_EVENTS) + ")")
def q_code_events(spark, sf):
    return events.code_events(levels(spark, sf), ALL_EVENTS, ["session"])


@query(CODED + " SELECT session, evt, obj, CAST(sum(v) AS DOUBLE) AS n FROM (" + " UNION ALL ".join(f"""SELECT session, obj, '{e}' AS evt, "{e}" AS v FROM more""" for e in ("re", "fe")) + ") GROUP BY ALL")
def q_event_counts(spark, sf):
    return events.event_counts(events.code_events(levels(spark, sf), ["re", "fe"], ["session"]), ["session"])


# --- events on the recording of the embeddings: object 0 and 1 flash by the parity of the sample's vector sums


def coded_stim(spark, sf):
    s = views.signal(spark, sf)
    o = s.select("session", "trial", "samp", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("obj"), (F.element_at("x", k + 1) > 0).cast("int").alias("level")) for k in range(3)])).alias("_o"))
    return o.select("session", "trial", "samp", "_o.obj", "_o.level")


KEYS = ["session", "trial"]
STIM = with_views("signal", "long_signal") + """,
stim AS (SELECT session, trial, samp, obj, CAST(x[obj + 1] > 0 AS INT) AS level FROM signal, (SELECT unnest(range(3)) AS obj)),
ev AS (SELECT session, trial, samp, obj, 're' AS evt, CAST(level > 0 AND lag(level) OVER w = 0 AS INT) AS v FROM stim WINDOW w AS (PARTITION BY session, trial, obj ORDER BY samp)
  UNION ALL SELECT session, trial, samp, obj, 'fe', CAST(level = 0 AND lag(level) OVER w > 0 AS INT) FROM stim WINDOW w AS (PARTITION BY session, trial, obj ORDER BY samp)),
last AS (SELECT session, trial, max(samp) AS last FROM signal GROUP BY ALL)"""


def events_re_fe(spark, sf):
    return events.code_events(coded_stim(spark, sf), ["re", "fe"], KEYS)


@query(STIM + " SELECT session, evt, lag, ch, ROUND(avg(s.v), 6) AS v, count(*) AS n FROM (SELECT *, unnest(range(8)) AS lag FROM ev WHERE v <> 0) e JOIN long_signal s ON s.session = e.session AND s.trial = e.trial AND s.samp = e.samp + e.lag GROUP BY e.session, evt, lag, ch".replace("SELECT session, evt", "SELECT e.session, evt"))
def q_erp(spark, sf):
    return r6(stats.erp(views.long_signal(spark, sf), events_re_fe(spark, sf), KEYS, ["session"], 8), "v")


@query(STIM + " SELECT e.session, obj, evt, lag, ch, ROUND(sum(e.v * s.v), 6) AS v FROM (SELECT ev.*, unnest(range(6)) AS lag FROM ev JOIN last USING (session, trial) WHERE v <> 0 AND samp <= last + 1 - 6) e JOIN long_signal s ON s.session = e.session AND s.trial = e.trial AND s.samp = e.samp + e.lag GROUP BY ALL")
def q_cov_xy(spark, sf):
    return r6(stats.cov_xy(views.long_signal(spark, sf), events_re_fe(spark, sf), KEYS, ["session"], 6), "v")


@query(STIM + " SELECT a.session, a.obj, a.evt AS evt1, b.evt AS evt2, a.samp - b.samp AS lag, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM ev a JOIN ev b ON a.session = b.session AND a.trial = b.trial AND a.obj = b.obj AND a.samp - b.samp BETWEEN 0 AND 5 WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL")
def q_cov_yy(spark, sf):
    return stats.cov_yy(events_re_fe(spark, sf), KEYS, ["session"], 6)


@query(STIM + " SELECT a.session, a.obj, b.obj AS obj2, a.evt AS evt1, b.evt AS evt2, a.samp - b.samp AS lag, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM ev a JOIN ev b ON a.session = b.session AND a.trial = b.trial AND a.samp - b.samp BETWEEN 0 AND 5 WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL")
def q_cov_yy_cross(spark, sf):
    return stats.cov_yy(events_re_fe(spark, sf), KEYS, ["session"], 6, cross=True)


@query(STIM + """, yy AS (SELECT a.session, a.evt AS evt1, b.evt AS evt2, a.samp - b.samp AS lag, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM ev a JOIN ev b ON a.session = b.session AND a.trial = b.trial AND a.obj = b.obj AND a.samp - b.samp BETWEEN 0 AND 5 WHERE a.v <> 0 AND b.v <> 0 AND a.obj = 0 GROUP BY ALL),
g AS (SELECT unnest(range(6)) AS i), gg AS (SELECT a.i, b.i AS j FROM g a, g b)
SELECT session, evt1, i, evt2, j, v FROM yy JOIN gg ON j - i = lag UNION ALL SELECT session, evt2, i, evt1, j, v FROM yy JOIN gg ON i - j = lag WHERE lag > 0""")
def q_toeplitz_expand(spark, sf):
    return stats.toeplitz_expand(stats.cov_yy(events_re_fe(spark, sf).where("obj = 0"), KEYS, ["session"], 6).drop("obj"), ["session"], 6)


@query(STIM + " SELECT a.session, b.samp - a.samp AS lag, b.ch AS d1, a.ch AS d2, ROUND(sum(a.v * b.v), 6) AS v FROM long_signal a JOIN long_signal b ON a.session = b.session AND a.trial = b.trial AND b.samp - a.samp BETWEEN 0 AND 3 GROUP BY ALL")
def q_autocov_xx(spark, sf):
    return r6(stats.autocov_xx(views.long_signal(spark, sf), KEYS, ["session"], 4), "v")


@query(STIM + " SELECT s.session, s.samp - e.samp AS lag, ch, obj, ROUND(sum(s.v * e.v), 6) AS v FROM (SELECT * FROM ev WHERE evt = 're' AND v <> 0) e JOIN long_signal s ON s.session = e.session AND s.trial = e.trial AND s.samp - e.samp BETWEEN -3 AND 4 GROUP BY ALL")
def q_crosscov_lags(spark, sf):
    return r6(stats.crosscov_lags(views.long_signal(spark, sf), events_re_fe(spark, sf).where("evt = 're'"), KEYS, ["session"], 4, 5), "v")


@query(with_views("samples") + """, t AS (SELECT session, unnest(range(4)) AS d1, unnest(x) AS a, x FROM samples), u AS (SELECT session, d1, a, unnest(range(4)) AS d2, unnest(x) AS b FROM t)
SELECT session, d1, d2, ROUND((sum(a * b) - sum(a) * sum(b) / count(*)) / count(*), 4) AS v FROM u GROUP BY ALL""")
def q_cov_xx(spark, sf):
    c = stats.cov_xx(views.samples(spark, sf), ["session"], centre=True, unit=True)
    return c.withColumn("v", F.round("v", 4) + F.lit(0.0))


# --- clocks


@query(with_views("clients") + """, w AS (SELECT *, cts % 67108864 AS wrapped FROM clients), p AS (SELECT *, pow(2, ceil(log2(max(wrapped) OVER (PARTITION BY client))))::BIGINT AS span, lag(wrapped) OVER (PARTITION BY client ORDER BY sts, seq) AS prev FROM w)
SELECT client, seq, wrapped, wrapped + (sum(CASE WHEN (prev - wrapped) * 2 > span THEN span ELSE 0 END) OVER (PARTITION BY client ORDER BY sts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS unwrapped FROM p""")
def q_unwrap_ts(spark, sf):
    w = clock.wrap_ts(views.clients(spark, sf), "cts", 26)
    return clock.unwrap_ts(w, ["client"], ["sts", "seq"], "wrapped").select("client", "seq", "wrapped", "unwrapped")


def fit_sql(rounds: int) -> str:
    out = ", b AS (SELECT client, min(cts) AS x0, min(sts) AS y0 FROM clients GROUP BY client), r0 AS (SELECT client, (cts - x0)::DOUBLE AS x, (sts - y0)::DOUBLE AS y FROM clients JOIN b USING (client))"
    for k in range(rounds):
        out += f", f{k} AS (SELECT client, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS n FROM r{k} GROUP BY client)"
        if k < rounds - 1:
            out += f", e{k} AS (SELECT client, x, y, abs(y - slope * x - intercept) AS err FROM r{k} JOIN f{k} USING (client)), r{k + 1} AS (SELECT client, x, y FROM (SELECT *, avg(err) OVER (PARTITION BY client) AS m FROM e{k}) WHERE err <= 3 * m)"
    return out


@query(with_views("clients") + fit_sql(4) + " SELECT client, ROUND(slope, 6) AS slope, ROUND(intercept, 2) AS intercept, n FROM f3")
def q_robust_clock_fit(spark, sf):
    f = clock.robust_clock_fit(views.clients(spark, sf), ["client"], "cts", "sts")
    return f.select("client", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query(with_views("clients") + """, d AS (SELECT *, CASE WHEN obj <= 2 THEN min(CASE WHEN obj <= 2 THEN sts - cts END) OVER (PARTITION BY client ORDER BY cts RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) END AS best FROM clients)
SELECT client, seq, last_value(best IGNORE NULLS) OVER (PARTITION BY client ORDER BY cts, seq ROWS UNBOUNDED PRECEDING) AS "offset" FROM d""")
def q_windowed_offset(spark, sf):
    return clock.windowed_offset(views.clients(spark, sf), ["client"], "cts", "sts", F.col("obj") <= 2, "seq", window=600_000_000).select("client", "seq", "offset")


@query(with_views("clients") + """ SELECT client, seq, min(CASE WHEN n <= 100 THEN sts - cts END) OVER (PARTITION BY client ORDER BY sts, seq ROWS UNBOUNDED PRECEDING) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY sts, seq) AS n FROM clients)""")
def q_running_min_offset(spark, sf):
    return clock.running_min_offset(views.clients(spark, sf), ["client"], ["sts", "seq"], "cts", "sts").select("client", "seq", "offset")


def packets(spark, sf):
    return views.stim_events(spark, sf).select("session", "event_id", "ts", (F.col("event_id") % 4 + 1).alias("nsamp"))


PACKETS = with_views("stim_events") + ", packets AS (SELECT session, event_id, ts, event_id % 4 + 1 AS nsamp FROM stim_events)"


@query(PACKETS + """, p AS (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS prev, unnest(range(1, nsamp + 1)) AS k FROM packets)
SELECT session, event_id, k, ROUND(CASE WHEN ts > prev THEN prev + (ts - prev) * k::DOUBLE / nsamp ELSE ts - (nsamp - k) * 4.0 END, 3) AS sample_ts FROM (SELECT session, event_id, ts, nsamp, prev, k FROM p)""".replace("p AS (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS prev, unnest(range(1, nsamp + 1)) AS k FROM packets)", "q AS (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS prev FROM packets), p AS (SELECT *, unnest(range(1, nsamp + 1)) AS k FROM q)"))
def q_interpolate_sample_ts(spark, sf):
    s = clock.interpolate_sample_ts(packets(spark, sf), ["session"], ["ts", "event_id"], fs=250.0)
    return s.select("session", "event_id", "k", F.round("sample_ts", 3).alias("sample_ts"))


@query(PACKETS + """, s AS (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS n FROM packets), d AS (SELECT session, ts - lag(ts) OVER (PARTITION BY session ORDER BY n) AS d FROM s WHERE n % 10 = 0)
SELECT session, ROUND(10000.0 / median(d) * 1e6, 6) AS fs FROM d GROUP BY session""")
def q_estimate_fs(spark, sf):
    f = clock.estimate_fs(packets(spark, sf), ["session"], ["ts", "event_id"], stride=10)
    return f.select("session", F.round(F.col("fs") * 1e6, 6).alias("fs"))


@query(PACKETS + """, r AS (SELECT *, sum(nsamp) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM packets), e AS (SELECT session, arg_min(ts, run) AS t0, arg_max(ts, run) AS t1, min(run) AS r0, max(run) AS r1 FROM r GROUP BY session),
x AS (SELECT session, ts - (t0 + (t1 - t0) * ((run - r0) / greatest(r1 - r0, 1)::DOUBLE)) AS err FROM r JOIN e USING (session)), c AS (SELECT session, median(err) AS centre FROM x GROUP BY session)
SELECT session, ROUND(any_value(centre), 1) AS centre, ROUND(quantile_cont(abs(err - centre), 0.75), 1) AS scale FROM x JOIN c USING (session) GROUP BY session""")
def q_timestamp_jitter(spark, sf):
    j = clock.timestamp_jitter(packets(spark, sf), ["session"], ["ts", "event_id"])
    return j.select("session", F.round("centre", 1).alias("centre"), F.round("scale", 1).alias("scale"))


INTERVALS = with_views("stim_events") + """, i AS (SELECT session, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS r FROM stim_events),
l AS (SELECT session, d FROM i WHERE r <= 120 AND d IS NOT NULL)"""


@query(INTERVALS + " SELECT session, count(*) AS n, ROUND(avg(d), 4) AS mean, median(d) AS median, ROUND(stddev_samp(d), 4) AS sd, min(d) AS least, max(d) AS most FROM l GROUP BY session")
def q_interval_stats(spark, sf):
    s = clock.interval_stats(views.stim_events(spark, sf), ["session"], ["ts", "event_id"])
    return s.withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query(INTERVALS + """, m AS (SELECT *, d - min(d) OVER (PARTITION BY session) AS x, 0.6::DOUBLE * (max(d) OVER (PARTITION BY session) - min(d) OVER (PARTITION BY session)) / 15 AS w FROM l)
SELECT session, bin, count(*) AS n FROM (SELECT session, CAST(CASE WHEN w > 0 THEN least(floor(x / w), CASE WHEN x <= 14 * w THEN 13 ELSE 99 END) ELSE 0 END AS INT) AS bin FROM m) WHERE bin < 14 GROUP BY session, bin""")
def q_interval_histogram(spark, sf):
    return clock.interval_histogram(views.stim_events(spark, sf), ["session"], ["ts", "event_id"])


# --- trials and segments


@query(with_views("markers") + """, a AS (SELECT *, coalesce(sum(CAST(kind = 'MODECHANGE' AS INT)) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM markers),
b AS (SELECT *, max(CAST(kind = 'NEWTARGET' AS INT)) OVER w AS opened, lead(ts) OVER (PARTITION BY session, segment ORDER BY ts, seq) AS stop FROM a WINDOW w AS (PARTITION BY session, segment ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT session, segment, row_number() OVER (PARTITION BY session, segment ORDER BY ts, seq) AS trial, ts AS bgn, stop AS "end" FROM b WHERE opened = 1 AND kind <> 'MODECHANGE' AND stop IS NOT NULL""")
def q_trials_from_markers(spark, sf):
    return segments.trials_from_markers(views.markers(spark, sf), ["session"])


GAP = 30_000_000
BOUNDS = ", bounds AS (SELECT session, min(ts) AS first_ts, max(ts) FILTER (r = 2) AS last_ts FROM (SELECT session, ts, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS r FROM stim_events) GROUP BY session)"


def bounds(spark, sf):
    from pyspark.sql.window import Window

    e = views.stim_events(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))))
    return e.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("r") == 2, F.col("ts"))).alias("last_ts"))


@query(with_views("stim_events") + BOUNDS + f""", p AS (SELECT session, ts, 1 AS k FROM stim_events WHERE state = 1 AND obj < 2 UNION ALL SELECT session, first_ts, 0 FROM bounds UNION ALL SELECT session, last_ts, 2 FROM bounds),
g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, k) > {GAP}, false) AS INT) AS gap FROM p), n AS (SELECT *, sum(gap) OVER (PARTITION BY session ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS no FROM g),
t AS (SELECT session, no, min(ts) AS bgn, max(ts) - min(ts) AS dur, max(k) FILTER (gap = 1) AS kind FROM n GROUP BY ALL), u AS (SELECT * FROM t JOIN (SELECT session, max(no) AS most FROM t GROUP BY session) USING (session) WHERE no > 0 AND no < most AND kind = 1),
l AS (SELECT session, quantile_cont(dur, 0.9) AS length FROM u GROUP BY session)
SELECT session, bgn, dur, ROUND(length, 3) AS length FROM u JOIN l USING (session) WHERE dur > 0.2 * length""")
def q_trials_from_gaps(spark, sf):
    s = views.stim_events(spark, sf).where("state = 1 and obj < 2")
    return segments.trials_from_gaps(s, bounds(spark, sf), ["session"], iti=GAP).withColumn("length", F.round("length", 3))


@query(LEVELS + """, e AS (SELECT session, samp FROM (SELECT session, samp, level, lag(level) OVER (PARTITION BY session, obj ORDER BY samp) AS p FROM levels WHERE obj = 0) WHERE level > 0 AND p = 0),
g AS (SELECT *, CAST(coalesce(samp - lag(samp) OVER (PARTITION BY session ORDER BY samp) > 6, false) AS INT) AS gap FROM e), t AS (SELECT session, samp, (sum(gap) OVER (PARTITION BY session ORDER BY samp ROWS UNBOUNDED PRECEDING))::BIGINT AS trial FROM g)
SELECT session, samp, trial, row_number() OVER (PARTITION BY session, trial ORDER BY samp) - 1 AS epoch FROM t""")
def q_epochs_from_gaps(spark, sf):
    e = events.code_events(levels(spark, sf).where("obj = 0"), ["re"], ["session"]).where("v = 1").select("session", "samp")
    return segments.epochs_from_gaps(e, ["session"], 6)


SEGS = with_views("stim_events") + """, segs AS (SELECT session, event_id AS seg, ts - 3000000 AS bgn, ts + 5000000 AS stop FROM stim_events WHERE obj = 4),
s AS (SELECT session, ts, event_id, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS nxt FROM stim_events)"""


@query(SEGS + " SELECT g.session, s.ts, s.event_id, g.seg FROM segs g JOIN s ON s.session = g.session AND s.ts < g.stop AND coalesce(s.nxt, 9e18) >= g.bgn")
def q_slice_segments(spark, sf):
    e = views.stim_events(spark, sf)
    g = e.where("obj = 4").select("session", F.col("event_id").alias("seg"), (F.col("ts") - 3_000_000).alias("bgn"), (F.col("ts") + 5_000_000).alias("end"))
    return segments.slice_segments(e.select("session", "ts", "event_id"), g, ["session"], width=10_000_000).select("session", "ts", "event_id", "seg")


@query(with_views("samples").replace("samples AS", "samples AS MATERIALIZED") + """, st AS MATERIALIZED (SELECT session, samp - 5 AS start, samp // 100 AS trial FROM samples WHERE samp % 100 = 0),
places AS MATERIALIZED (SELECT session, trial, k, start - 2 + k AS place FROM st, (SELECT unnest(range(0, 24)) AS k) ks)
SELECT p.session, p.trial, p.k AS samp, coalesce(x[1], 0) AS a, coalesce(x[2], 0) AS b, coalesce(x[3], 0) AS c, coalesce(x[4], 0) AS d FROM places p LEFT JOIN samples s ON s.session = p.session AND s.samp = p.place""")
def q_slice_trials(spark, sf):
    s = views.samples(spark, sf)
    st = s.where("samp % 100 = 0").select("session", (F.col("samp") - 5).alias("start"), F.floor(F.col("samp") / 100).alias("trial"))
    return segments.slice_trials(s.select("session", "samp", *[F.element_at("x", k + 1).alias("abcd"[k]) for k in range(4)]), st, ["session"], 20, before=-2, after=2, columns=[*"abcd"])


def ragged(spark, sf):
    """Every output of every trial as a series of its own length."""
    return views.fy(spark, sf).select((F.col("trial") % 7).alias("session"), (F.col("trial") * 8 + F.col("obj")).alias("trial"), "samp", "v")


@query(with_views("fy") + """, r AS (SELECT trial % 7 AS session, trial * 8 + obj AS trial, samp, v FROM fy), n AS (SELECT session, trial, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT session, floor(quantile_cont(n, 0.75))::INT AS len FROM n GROUP BY session),
k AS (SELECT session, trial, len, unnest(range(len)) AS samp FROM n JOIN c USING (session) WHERE n * 2 > len)
SELECT session, trial, samp, last_value(v IGNORE NULLS) OVER (PARTITION BY session, trial ORDER BY samp ROWS UNBOUNDED PRECEDING) AS v FROM k LEFT JOIN r USING (session, trial, samp)""")
def q_fit_trial_length(spark, sf):
    return segments.fit_trial_length(ragged(spark, sf), ["session"])


@query(with_views("signal", "long_signal") + " SELECT session, trial, ch, samp, win[1] AS first, ROUND(list_sum(win), 6) AS total FROM (SELECT session, trial, ch, samp, list(v) OVER (PARTITION BY session, trial, ch ORDER BY samp ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS win FROM long_signal) WHERE len(win) = 5 AND samp % 3 = 0")
def q_sliding_windows(spark, sf):
    s = segments.sliding_windows(views.long_signal(spark, sf), [*KEYS, "ch"], 5, 3)
    return s.select(*KEYS, "ch", "samp", F.element_at("win", 1).alias("first"), F.round(F.aggregate("win", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query(STIM + " SELECT e.session, e.trial, e.samp, e.obj, lag, s.ch, s.v FROM (SELECT *, unnest(range(4)) AS lag FROM ev WHERE evt = 're' AND v <> 0) e JOIN long_signal s ON s.session = e.session AND s.trial = e.trial AND s.samp = e.samp + lag")
def q_epoch_slices(spark, sf):
    e = events_re_fe(spark, sf).where("evt = 're' and v <> 0").select(*KEYS, "samp", "obj")
    return segments.epoch_slices(views.long_signal(spark, sf), e, KEYS, 4, ["ch", "v"]).select(*KEYS, "samp", "obj", "lag", "ch", "v")


@query(with_views("fy") + """, r AS (SELECT trial % 7 AS session, trial * 8 + obj AS trial, samp, v, count(*) OVER (PARTITION BY trial, obj) AS n FROM fy), s AS (SELECT *, floor(n / greatest(floor(n / 10.0 / 1.5), 1))::INT AS size FROM r)
SELECT session, trial, (samp % size)::INT AS samp, v, (samp // size)::INT AS sub FROM s WHERE (samp // size + 1) * size <= n""")
def q_subtrials(spark, sf):
    return segments.subtrials(ragged(spark, sf), ["session"], 10.0, 1.5)


@query(with_views("stim_events") + """, r AS (SELECT session, min(ts) AS a, max(ts) AS b FROM stim_events WHERE obj = 0 AND state = 1 GROUP BY session) SELECT session, event_id, ts FROM stim_events JOIN r USING (session) WHERE ts >= a - 1000 AND ts <= b + 1000""")
def q_trim_to_range(spark, sf):
    e = views.stim_events(spark, sf)
    return segments.trim_to_range(e.select("session", "event_id", "ts"), e.where("obj = 0 and state = 1"), ["session"])


@query(with_views("signal") + """, code AS (SELECT l_orderkey AS event_idx, l_linenumber - 1 AS obj, CAST(max(l_quantity) > 25 AS INT) AS level FROM lineitem GROUP BY ALL), n AS (SELECT max(event_idx) + 1 AS n FROM code),
j AS (SELECT s.session, s.trial, s.samp, c.obj, c.level, s.session % 7 AS target FROM signal s, n JOIN code c ON c.event_idx = s.samp % n.n)
SELECT session, trial, samp, obj + 1 AS obj, level FROM j UNION ALL SELECT session, trial, samp, 0, level FROM j WHERE obj = target""")
def q_join_codebook(spark, sf):
    from pulsegrid.shared import table

    code = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event_idx"), (F.col("l_linenumber") - 1).alias("obj")).agg((F.max("l_quantity") > 25).cast("int").alias("level"))
    s = views.signal(spark, sf).select(*KEYS, "samp", (F.col("session") % 7).alias("target"))
    return segments.join_codebook(s, code, KEYS)


@query("SELECT event_id, 'buy' AS cls, CAST(event_type IN ('purchase', 'signup') AS INT) AS v FROM events UNION ALL SELECT event_id, 'look', CAST(event_type IN ('view', 'click') AS INT) FROM events")
def q_label_indicator(spark, sf):
    from pulsegrid.shared import table

    e = table(spark, sf, "events").select("event_id", "event_type")
    return segments.label_indicator(e, "event_type", {"buy": ["purchase", "signup"], "look": ["view", "click"]}).drop("event_type")


@query(STIM + """, e AS (SELECT session, trial, samp, obj, level FROM stim WHERE samp % 6 = 0), x AS (SELECT session, trial, obj, level, samp AS a, unnest(range(samp + 1, samp + 10)) AS here FROM e)
SELECT session, trial, here AS samp, obj, arg_max(level, a) AS level FROM x WHERE here >= 0 AND here < 22 GROUP BY session, trial, here, obj""")
def q_upsample_codebook(spark, sf):
    return segments.upsample_codebook(coded_stim(spark, sf).where("samp % 6 = 0"), KEYS, 9, 22, offset=1)


@query(STIM + """, m AS (SELECT session, trial, min(m) AS m FROM (SELECT session, trial, obj, max(samp) AS m FROM stim WHERE samp < 25 - obj GROUP BY ALL) GROUP BY ALL), s AS (SELECT stim.* FROM stim JOIN m USING (session, trial) WHERE samp < 25 - obj AND samp <= m)
SELECT session, trial, samp, 0 AS obj, level::DOUBLE AS v FROM s WHERE obj = session % 3 UNION ALL SELECT session, trial, samp, obj + 1, level::DOUBLE FROM s""")
def q_stack_streams(spark, sf):
    s = coded_stim(spark, sf).where("samp < 25 - obj").select(*KEYS, "samp", F.col("obj").alias("stream"), F.col("level").cast("double").alias("v"))
    return segments.stack_streams(s, s.select(*KEYS).distinct().withColumn("attended", F.col("session") % 3), KEYS)


@query(STIM + """, n AS (SELECT session, trial, max(samp) // 5 + 1 AS n FROM stim GROUP BY ALL), g AS (SELECT session, trial, n, unnest(range(n)) AS dest FROM n WHERE n > 1),
h AS (SELECT *, ('0x' || substr(md5('0:' || perm || ':' || dest), 1, 12))::BIGINT AS h FROM g, (SELECT unnest(range(3)) AS perm)), b AS (SELECT *, (dest + 1 + h % (n - 1)) % n AS blk, (h >> 8) % 3 AS obj FROM h)
SELECT session, trial, samp, obj, level FROM stim UNION ALL SELECT b.session, b.trial, dest * 5 + s.samp % 5, 1000 + perm, s.level FROM b JOIN stim s ON s.session = b.session AND s.trial = b.trial AND s.obj = b.obj AND s.samp // 5 = b.blk""")
def q_virtual_outputs(spark, sf):
    return segments.virtual_outputs(coded_stim(spark, sf), KEYS, 3, 5)


@query(STIM + " SELECT session, trial, samp, obj, level FROM (SELECT *, max(level) OVER (PARTITION BY session, trial, obj) AS m FROM stim) WHERE (m <> 0 OR obj = 0) AND obj <= 1")
def q_drop_unused_outputs(spark, sf):
    return segments.limit_outputs(segments.drop_unused_outputs(coded_stim(spark, sf), KEYS), 1)


# --- cleaning


@query(with_views("signal", "long_signal") + " SELECT session, trial, samp, ch, ROUND(v - avg(v) OVER (PARTITION BY session, trial, ch), 6) + 0.0 AS v FROM long_signal")
def q_center_trials(spark, sf):
    return r6(clean.center_trials(views.long_signal(spark, sf), KEYS), "v")


@query(with_views("signal", "long_signal") + " SELECT session, trial, samp, ch, ROUND(v - avg(v) OVER (PARTITION BY session, trial, samp), 6) + 0.0 AS v FROM long_signal")
def q_common_average_reference(spark, sf):
    return r6(clean.common_average_reference(views.signal(spark, sf)).select(*KEYS, "samp", F.posexplode("x").alias("ch", "v")), "v")


def outlier_sql(source: str, by: str, thresh: float) -> str:
    out = f", o0 AS (SELECT session, {by}, sqrt(sum(v * v)) AS p, false AS bad FROM {source} GROUP BY session, {by})"
    for k in range(4):
        out += f", o{k + 1} AS (SELECT session, {by}, p, bad OR p > avg(p) FILTER (NOT bad) OVER w + {thresh} * stddev_pop(p) FILTER (NOT bad) OVER w AS bad FROM o{k} WINDOW w AS (PARTITION BY session))"
    return out


@query(with_views("signal", "long_signal") + outlier_sql("long_signal", "ch", 1.2) + " SELECT session, ch, ROUND(p, 6) AS p, bad FROM o4")
def q_bad_channels(spark, sf):
    return r6(clean.bad_channels(views.long_signal(spark, sf), ["session"], 1.2), "p")


@query(with_views("signal", "long_signal") + outlier_sql("long_signal", "trial", 0.85) + " SELECT s.session, s.trial, samp, ch, v FROM long_signal s JOIN o4 ON s.session = o4.session AND s.trial = o4.trial WHERE NOT bad")
def q_bad_trials(spark, sf):
    s = views.long_signal(spark, sf)
    return clean.drop_bad(s, clean.bad_trials(s, ["session"], thresh=0.85), KEYS)


@query(with_views("signal", "long_signal") + outlier_sql("long_signal", "trial", 0.6) + """, z AS (SELECT s.session, s.trial, samp, ch, CASE WHEN bad THEN 0 ELSE v END AS v FROM long_signal s JOIN o4 ON s.session = o4.session AND s.trial = o4.trial)""" + outlier_sql("z", "trial, ch", 1.2).replace("o0", "c0").replace("o1", "c1").replace("o2", "c2").replace("o3", "c3").replace("o4", "c4") + " SELECT z.session, z.trial, samp, z.ch, CASE WHEN bad THEN 0 ELSE v END AS v FROM z JOIN c4 ON z.session = c4.session AND z.trial = c4.trial AND z.ch = c4.ch")
def q_zero_outliers(spark, sf):
    return clean.zero_outliers(views.long_signal(spark, sf), ["session"], thresh=0.6)


ROBUST = ", g0 AS (SELECT session, unnest(range(4)) AS ch, unnest(x)::DOUBLE AS v, true AS ok FROM samples)" + "".join(f", g{k + 1} AS (SELECT session, ch, v, v <= m + 1.5 * s AND v >= m - 1.2 * s AS ok FROM (SELECT *, avg(v) FILTER (ok) OVER w AS m, stddev_pop(v) FILTER (ok) OVER w AS s FROM g{k} WINDOW w AS (PARTITION BY session, ch)))" for k in range(4))


@query(with_views("samples") + ROBUST + " SELECT session, ch, ROUND(avg(v), 6) AS mean, count(*) AS n FROM g4 WHERE ok GROUP BY session, ch")
def q_robust_mean(spark, sf):
    s = views.samples(spark, sf).select("session", F.posexplode("x").alias("ch", "v"))
    return r6(clean.robust_mean(s, ["session", "ch"], high=1.5, low=1.2), "mean")


@query(with_views("signal") + """, a AS (SELECT session, trial, samp, x[1] AS v, lead(x[1]) OVER (PARTITION BY session, trial ORDER BY samp) AS nx FROM signal), b AS (SELECT session, trial, 2 * samp + k AS here, k, v, nx FROM a, (SELECT unnest([0, 1]) AS k))
SELECT session, trial, here // 3 AS samp, ROUND(CASE WHEN k = 1 THEN (v + nx) / 2 ELSE v END, 6) AS v FROM b WHERE here % 3 = 0 AND (k = 0 OR nx IS NOT NULL)""")
def q_decimate(spark, sf):
    s = views.signal(spark, sf).select(*KEYS, "samp", F.element_at("x", 1).alias("v"))
    return r6(clean.decimate(s, 1.5, KEYS, ["v"]), "v")


@query(STIM + " SELECT session, trial, obj, evt, samp // 3 AS samp, CAST(max(v) AS DOUBLE) AS v FROM (SELECT * REPLACE (coalesce(v, 0) AS v) FROM ev) GROUP BY ALL")
def q_downsample_max(spark, sf):
    return clean.downsample_max(events_re_fe(spark, sf), 3, [*KEYS, "obj", "evt"])


@query(with_views("signal") + """ SELECT session, trial, samp, len(e) AS n, e[1] AS a, e[9] AS b, e[24] AS c FROM (SELECT session, trial, samp, list_concat(list_concat(x, lead(x, 2) OVER w), lead(x, 4) OVER w) AS e, lead(x, 4) OVER w AS far FROM signal WINDOW w AS (PARTITION BY session, trial ORDER BY samp)) WHERE far IS NOT NULL""")
def q_fir_embed(spark, sf):
    e = clean.fir_embed(views.signal(spark, sf), KEYS, 3, 2)
    return e.select(*KEYS, "samp", F.size("x").cast("bigint").alias("n"), *[F.element_at("x", i).alias(c) for i, c in ((1, "a"), (9, "b"), (24, "c"))])


@query(with_views("samples") + ", c AS (SELECT session, samp, unnest(range(4)) AS ch, unnest(x)::DOUBLE AS v FROM samples) SELECT session, samp, ch, ROUND((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) + 0.0 AS v FROM c WINDOW w AS (PARTITION BY session, ch)")
def q_zscore_targets(spark, sf):
    s = views.samples(spark, sf).select("session", "samp", F.posexplode("x").alias("ch", "v"))
    return r6(clean.zscore_targets(s, ["session", "ch"]), "v")


@query(with_views("signal", "long_signal") + """, p AS (SELECT session, ch, avg(v * v) AS raw, var_pop(v) AS pre FROM long_signal GROUP BY ALL)
SELECT session, ch, ROUND(CASE WHEN raw < 1e-6 OR sqrt(greatest(pre, 1e-8)) > 10 * sqrt(greatest(raw, 1e-8)) THEN 100.0 ELSE least(100.0, greatest(1e-6, abs(sqrt(greatest(raw, 1e-8)) - sqrt(greatest(pre, 1e-8)))) / sqrt(greatest(pre, 1e-8))) END, 5) AS q FROM p""")
def q_noise_to_signal(spark, sf):
    p = views.long_signal(spark, sf).groupBy("session", "ch").agg(F.avg(F.col("v") * F.col("v")).alias("raw"), F.var_pop("v").alias("pre"))
    return p.select("session", "ch", F.round(clean.noise_to_signal(F.col("raw"), F.col("pre")), 5).alias("q"))


# --- scores of outputs

T = ["trial"]
FY = with_views("fy") + """,
dense AS MATERIALIZED (SELECT trial, obj, samp, coalesce(v, 0) AS v FROM (SELECT trial, obj, unnest(range(m + 1)) AS samp FROM (SELECT trial, max(samp) AS m FROM fy GROUP BY trial) JOIN (SELECT DISTINCT trial, obj FROM fy) USING (trial)) LEFT JOIN fy USING (trial, obj, samp)),
valid AS (SELECT trial, count(s) AS ny, coalesce(max(s), 0) AS nep FROM (SELECT trial, obj, max(samp) FILTER (v <> 0) AS s FROM fy GROUP BY ALL) GROUP BY trial),
act AS (SELECT trial, samp, (sum(a) OVER (PARTITION BY trial ORDER BY samp ROWS UNBOUNDED PRECEDING))::BIGINT AS n, a FROM (SELECT trial, samp, max(CAST(v <> 0 AS INT)) AS a FROM dense GROUP BY ALL)),
cum AS MATERIALIZED (SELECT d.trial, d.samp, obj, v, sum(v) OVER (PARTITION BY d.trial, obj ORDER BY d.samp ROWS UNBOUNDED PRECEDING) AS s, n, a, ny FROM dense d JOIN act ON act.trial = d.trial AND act.samp = d.samp JOIN valid ON valid.trial = d.trial)"""
SIGMA = FY + """,
vs AS (SELECT trial, samp, n, ny, (CASE WHEN any_value(many) THEN sum(s * s) - 2 * sum(s) / ny * sum(s) + count(*) * (sum(s) / ny) * (sum(s) / ny) ELSE sum(s * s) END) / greatest(0.1, ny - 1) / greatest(0.1, n) AS q FROM cum, (SELECT min(ny) > 3 AS many FROM valid) GROUP BY trial, samp, n, ny),
sig AS (SELECT trial, samp, n, sum(q) OVER (PARTITION BY trial ORDER BY samp ROWS UNBOUNDED PRECEDING) / greatest(0.1, n) AS sigma2 FROM vs)"""
Z = SIGMA + """, zs AS MATERIALIZED (SELECT c.trial, c.samp, obj, s / CASE WHEN sigma2 * greatest(0.01, g.n) = 0 THEN 1 ELSE sqrt(sigma2 * greatest(0.01, g.n)) END AS z FROM cum c JOIN sig g ON g.trial = c.trial AND g.samp = c.samp)"""
P = Z + """, f AS (SELECT *, max(CAST(z <> 0 AS INT)) OVER (PARTITION BY trial, obj) AS ok, max(z) OVER (PARTITION BY trial, samp) AS top FROM zs), e AS (SELECT *, exp(z - top) * ok AS e FROM f), ps AS (SELECT trial, samp, obj, e / greatest(sum(e) OVER (PARTITION BY trial, samp), 1e-6) AS p FROM e)"""


@query(FY + " SELECT trial, ny, nep FROM valid")
def q_valid_outputs(spark, sf):
    return scores.valid_outputs(views.fy(spark, sf), T)


@query(with_views("fy") + """, l AS (SELECT trial, max(samp) AS last FROM fy GROUP BY trial) SELECT trial, unnest(list_distinct(list_append(range(4, last, 5), last))) AS samp FROM l""")
def q_decision_points(spark, sf):
    n = views.fy(spark, sf).groupBy("trial").agg((F.max("samp") + 1).alias("n"))
    return scores.decision_grid(n, least=-5).select("trial", "samp")


@query(FY + " SELECT trial, samp, obj, ROUND(s, 6) + 0.0 AS s, n FROM cum")
def q_cumulative_scores(spark, sf):
    return r6(scores.cumulative_scores(views.fy(spark, sf), T).select("trial", "samp", "obj", "s", "n"), "s")


@query(SIGMA + " SELECT trial, samp, n, ROUND(sigma2, 5) + 0.0 AS sigma2 FROM sig")
def q_noise_variance(spark, sf):
    return scores.noise_variance(views.fy(spark, sf), T).withColumn("sigma2", F.round("sigma2", 5) + F.lit(0.0))


@query(FY + """, vs AS (SELECT trial, samp, n, ny, (CASE WHEN ny > 3 THEN sum(s * s) - 2 * sum(s) / ny * sum(s) + ny * (sum(s) / ny) * (sum(s) / ny) ELSE sum(s * s) END) / greatest(0.1, ny - 1) / n AS q FROM cum WHERE a = 1 GROUP BY trial, samp, n, ny)
SELECT trial, samp, n, ROUND((sum(q) OVER (PARTITION BY trial ORDER BY samp ROWS UNBOUNDED PRECEDING) / n * n + 0.5 * 10) / (n + 10), 5) + 0.0 AS sigma2 FROM vs""")
def q_noise_variance_compact(spark, sf):
    return scores.noise_variance(views.fy(spark, sf), T, compact=True, prior=(0.5, 10.0)).withColumn("sigma2", F.round("sigma2", 5) + F.lit(0.0))


@query(Z + " SELECT trial, samp, obj, ROUND(z, 5) + 0.0 AS z FROM zs")
def q_normalize_scores(spark, sf):
    return scores.normalize_scores(views.fy(spark, sf), T).withColumn("z", F.round("z", 5) + F.lit(0.0))


@query(FY + """, w AS (SELECT trial, obj, samp, (0.5 * v + 0.3 * coalesce(lag(v) OVER o, 0) + 0.2 * coalesce(lag(v, 2) OVER o, 0)) / (0.5 + CASE WHEN samp >= 1 THEN 0.3 ELSE 0 END + CASE WHEN samp >= 2 THEN 0.2 ELSE 0 END) AS v FROM dense WINDOW o AS (PARTITION BY trial, obj ORDER BY samp)) SELECT trial, obj, samp, ROUND(v, 6) + 0.0 AS v FROM w""")
def q_smooth_scores(spark, sf):
    return r6(scores.smooth_scores(views.fy(spark, sf), T, [0.5, 0.3, 0.2]), "v")


@query(P + " SELECT trial, samp, obj, ROUND(p, 6) + 0.0 AS p FROM ps")
def q_target_probs(spark, sf):
    z = scores.normalize_scores(views.fy(spark, sf), T)
    return r6(scores.target_probs(z, ["trial", "samp"]).select("trial", "samp", "obj", "p"), "p")


@query(P + " SELECT trial, samp, -b.o AS yest, ROUND(1 - b.p, 6) + 0.0 AS perr FROM (SELECT trial, samp, max({'p': ROUND(p, 9), 'o': -obj}) AS b FROM ps GROUP BY ALL)")
def q_select_output(spark, sf):
    z = scores.normalize_scores(views.fy(spark, sf), T)
    return r6(scores.select_output(scores.target_probs(z, ["trial", "samp"]), ["trial", "samp"]), "perr")


@query(P + " SELECT trial, samp, ROUND(sum(p * ln(greatest(p, 1e-8))), 5) + 0.0 AS entropy FROM ps GROUP BY ALL")
def q_entropy(spark, sf):
    z = scores.normalize_scores(views.fy(spark, sf), T)
    return scores.entropy(scores.target_probs(z, ["trial", "samp"]), ["trial", "samp"]).withColumn("entropy", F.round("entropy", 5) + F.lit(0.0))


@query(P + """, c AS (SELECT trial, obj, sum(ln(greatest(p, 1e-8))) / sqrt(count(*)) AS l FROM ps GROUP BY ALL), x AS (SELECT *, exp(l - max(l) OVER (PARTITION BY trial)) AS e FROM c) SELECT trial, obj, ROUND(e / sum(e) OVER (PARTITION BY trial), 5) + 0.0 AS p FROM x""")
def q_combine_probs(spark, sf):
    z = scores.normalize_scores(views.fy(spark, sf), T)
    return scores.combine_probs(scores.target_probs(z, ["trial", "samp"]), T).withColumn("p", F.round("p", 5) + F.lit(0.0))


@query(with_views("fy") + ", x AS (SELECT *, exp(v - max(v) OVER (PARTITION BY trial, samp)) AS e FROM fy) SELECT trial, samp, ROUND(sum(v * e) / sum(e), 6) + 0.0 AS v FROM x GROUP BY ALL")
def q_marginalize_scores(spark, sf):
    return r6(scores.marginalize_scores(views.fy(spark, sf), ["trial", "samp"]), "v")


@query(Z + f""", g AS (SELECT DISTINCT trial FROM zs WHERE obj = 0 AND z <> 0), k AS (SELECT unnest([{", ".join(map(str, scores.SCALES))}]::DOUBLE[]) AS scale), f AS (SELECT trial, samp, obj, scale, z * scale AS z FROM zs SEMI JOIN g USING (trial), k),
h AS (SELECT *, max(z) OVER (PARTITION BY scale, trial, samp) AS top, max(CAST(z <> 0 AS INT)) OVER (PARTITION BY scale, trial, obj) AS ok FROM f), e AS (SELECT *, exp(z - top) * ok AS e FROM h), q AS (SELECT *, e / greatest(sum(e) OVER (PARTITION BY scale, trial, samp), 1e-6) AS p FROM e),
l AS (SELECT scale, -sum(ln(greatest(p, 1e-5))) AS loss FROM q WHERE obj = 0 GROUP BY scale) SELECT scale, ROUND(loss, 2) AS loss FROM l ORDER BY loss LIMIT 1""")
def q_calibrate_softmax(spark, sf):
    return scores.calibrate_softmax(scores.normalize_scores(views.fy(spark, sf), T), ["trial", "samp"]).withColumn("loss", F.round("loss", 2))


@query(P + " SELECT trial, samp, obj, ROUND(p, 6) + 0.0 AS p FROM ps WHERE p > 0 OR obj = 0")
def q_sparse_distribution(spark, sf):
    z = scores.normalize_scores(views.fy(spark, sf), T)
    return r6(scores.sparse_distribution(scores.target_probs(z, ["trial", "samp"]), ["trial", "samp"]).select("trial", "samp", "obj", "p"), "p")


BLOCKS = FY + """, u AS (SELECT DISTINCT trial, obj FROM dense WHERE v <> 0), d AS (SELECT *, samp // 10 AS blk FROM dense SEMI JOIN u USING (trial, obj) JOIN (SELECT trial, (max(samp) + 1) // 10 AS nb FROM dense GROUP BY trial) USING (trial) WHERE samp // 10 < nb),
r AS (SELECT *, v - avg(v) OVER (PARTITION BY trial, blk, samp) - avg(v) OVER (PARTITION BY trial, blk, obj) + avg(v) OVER (PARTITION BY trial, blk) AS r FROM d), b AS (SELECT trial, blk, sum(r * r) / greatest(1, count(*) - count(DISTINCT obj)) AS q FROM r GROUP BY ALL)"""


@query("WITH RECURSIVE " + BLOCKS.removeprefix("WITH ") + """, m(trial, blk, s2) AS (SELECT trial, blk, q FROM b WHERE blk = 0 UNION ALL SELECT b.trial, b.blk, (m.s2 + b.q) / 2 FROM m JOIN b ON b.trial = m.trial AND b.blk = m.blk + 1),
s AS (SELECT trial, blk, obj, sum(sum(v)) OVER (PARTITION BY trial, obj ORDER BY blk ROWS UNBOUNDED PRECEDING) AS s FROM d GROUP BY trial, blk, obj)
SELECT trial, blk, obj, ROUND(s / CASE WHEN s2 > 0 THEN sqrt((blk + 1) * 10 * s2) ELSE 1 END, 5) + 0.0 AS z FROM s JOIN m USING (trial, blk)""")
def q_normalize_blocks(spark, sf):
    return scores.normalize_blocks(views.fy(spark, sf), T, 10).withColumn("z", F.round("z", 5) + F.lit(0.0))




def fe(spark, sf):
    """Scores of events: channel 0 and 1 of the recording stand for re and fe."""
    s = views.signal(spark, sf)
    return s.select(*KEYS, "samp", F.explode(F.array(*[F.struct(F.lit(e).alias("evt"), F.element_at("x", i + 1).alias("v")) for i, e in enumerate(("re", "fe"))])).alias("_e")).select(*KEYS, "samp", "_e.evt", "_e.v")


FES = STIM + ", fe AS (SELECT session, trial, samp, 're' AS evt, x[1] AS v FROM signal UNION ALL SELECT session, trial, samp, 'fe', x[2] FROM signal)"


@query(FES + " SELECT session, trial, samp, obj, ROUND(sum(ev.v * fe.v), 6) + 0.0 AS v FROM ev JOIN fe USING (session, trial, samp, evt) WHERE ev.v <> 0 GROUP BY ALL")
def q_score_output(spark, sf):
    return r6(scores.score_output(fe(spark, sf), events_re_fe(spark, sf), KEYS), "v")


@query(FES + """ SELECT fe.session, fe.trial, o AS "offset", fe.samp, obj, ROUND(sum(ev.v * fe.v), 6) + 0.0 AS v FROM ev JOIN (SELECT unnest([-2, 0, 3]) AS o) ON true JOIN fe ON fe.session = ev.session AND fe.trial = ev.trial AND fe.evt = ev.evt AND fe.samp = ev.samp + o WHERE ev.v <> 0 GROUP BY ALL""")
def q_score_output_offsets(spark, sf):
    return r6(scores.score_output_offsets(fe(spark, sf), events_re_fe(spark, sf), KEYS, [-2, 0, 3]), "v")


@query(with_views("fy") + """, t AS (SELECT trial, obj, samp, v FROM fy), d AS (SELECT trial, obj, samp, coalesce(v, 0) AS v FROM (SELECT trial, obj, unnest(range(m + 1)) AS samp FROM (SELECT trial, max(samp) AS m FROM fy GROUP BY trial) JOIN (SELECT DISTINCT trial, obj FROM fy) USING (trial)) LEFT JOIN fy USING (trial, obj, samp)),
tr AS (SELECT trial, samp, v AS t FROM d WHERE obj = 0), al AS (SELECT trial FROM tr GROUP BY trial HAVING max(CAST(t <> 0 AS INT)) = 1), si AS (SELECT trial, obj, avg(CAST(v = t AS INT)) AS s FROM d JOIN tr USING (trial, samp) SEMI JOIN al USING (trial) WHERE obj <> 0 GROUP BY ALL),
be AS (SELECT trial, max({'s': s, 'o': -obj}) AS b FROM si GROUP BY trial) SELECT d.trial, d.obj, d.samp, CASE WHEN d.obj = -b.o AND b.s > 0.02 THEN 0 ELSE v END AS v FROM d LEFT JOIN be USING (trial)""")
def q_dedup_true_output(spark, sf):
    return scores.dedup_true_output(views.fy(spark, sf), T, least=0.02).select("trial", "obj", "samp", "v")


@query(FY + """, g AS (SELECT DISTINCT trial FROM dense WHERE obj = 0 AND v <> 0), l AS (SELECT trial, samp, max({'c': ROUND(s, 9), 'o': -obj}) AS b FROM cum SEMI JOIN g USING (trial) GROUP BY ALL) SELECT trial % 5 AS grp, ROUND(avg(CAST(b.o = 0 AS INT)), 6) AS score FROM l GROUP BY ALL""")
def q_audc_score(spark, sf):
    f = views.fy(spark, sf).withColumn("grp", F.col("trial") % 5)
    return r6(scores.audc_score(f, ["grp", "trial"], ["grp"]), "score")


@query(with_views("fy") + """, m AS (SELECT trial % 4 AS model, trial, obj, samp, v / 100 AS v FROM fy), t AS (SELECT model, sum(v) AS t FROM m GROUP BY model), w AS (SELECT model, exp(t - (SELECT max(t) FROM t)) / (SELECT sum(exp(t - (SELECT max(t) FROM t))) FROM t) AS w FROM t)
SELECT samp, obj, ROUND(sum(v * w), 6) + 0.0 AS v FROM m JOIN w USING (model) GROUP BY ALL""")
def q_model_weights(spark, sf):
    f = views.fy(spark, sf).select((F.col("trial") % 4).alias("model"), "obj", "samp", (F.col("v") / 100).alias("v"))
    return r6(scores.model_weights(f, []), "v")


# --- evaluation

LENGTHS = [5, 10, 20, 40]
CURVE = P + f""", g AS (SELECT DISTINCT trial FROM fy WHERE obj = 0 AND v <> 0), n AS (SELECT unnest({LENGTHS}) AS len), t AS (SELECT trial, len, max({{'p': ROUND(pp, 9), 'o': -obj}}) AS b FROM
 (SELECT trial, len, obj, e / greatest(sum(e) OVER (PARTITION BY trial, len), 1e-6) AS pp FROM (SELECT trial, len, obj, exp(z - max(z) OVER (PARTITION BY trial, len)) * max(CAST(z <> 0 AS INT)) OVER (PARTITION BY trial, len, obj) AS e FROM zs SEMI JOIN g USING (trial) JOIN n ON samp = len - 1)) GROUP BY ALL),
trials AS (SELECT trial, len, -b.o AS yest, 1 - b.p AS perr, CAST(b.o <> 0 AS INT) AS yerr FROM t), curve AS (SELECT len, avg(yerr) AS err, avg(perr) AS err_est FROM trials GROUP BY len)"""


@query(CURVE + " SELECT len, ROUND(err, 6) AS err, ROUND(err_est, 6) AS err_est FROM curve")
def q_decoding_curve(spark, sf):
    return r6(evaluate.decoding_curve(views.fy(spark, sf), T, LENGTHS)[1], "err", "err_est")


OWN = CURVE.replace(f"n AS (SELECT unnest({LENGTHS}) AS len)", "top AS (SELECT max(samp) + 1 AS n FROM fy SEMI JOIN g USING (trial)), n AS (SELECT DISTINCT CASE WHEN n > 30 THEN n * k // 30 ELSE k END AS len FROM top, (SELECT unnest(range(1, 31)) AS k) WHERE n > 30 OR k <= n)").replace("(l_quantity - 25) / 10 AS v", "(l_quantity - 25) AS v")


@query(OWN + " SELECT len, ROUND(err, 6) AS err, ROUND(err_est, 6) AS err_est FROM curve")
def q_decoding_curve_own_lengths(spark, sf):
    whole = views.fy(spark, sf).withColumn("v", F.round(F.col("v") * 10))  # whole numbers: a sum of 0 is 0 in every order
    return r6(evaluate.decoding_curve(whole, T)[1], "err", "err_est")


STOP = CURVE + f""", th AS (SELECT unnest(range({23})) AS no, unnest([{", ".join(repr(t) for t in evaluate.stop_thresholds(20))}]::DOUBLE[]) AS thresh),
st AS (SELECT trial, no, thresh, coalesce(min({{'len': len, 'perr': perr, 'yerr': yerr}}) FILTER (perr < thresh), max({{'len': len, 'perr': perr, 'yerr': yerr}})) AS s FROM trials, th GROUP BY ALL),
ms AS (SELECT no, thresh, avg(s.len) AS stop_len, avg(s.perr) AS stop_perr, avg(s.yerr) AS stop_err FROM st GROUP BY ALL),
stops AS (SELECT len, b.thresh AS stop_thresh, b.sp AS stop_perr, b.se AS stop_err FROM (SELECT len, min({{'d': ROUND(abs(len - stop_len), 9), 'no': no, 'thresh': thresh, 'sp': stop_perr, 'se': stop_err}}) AS b FROM (SELECT DISTINCT len FROM trials), ms GROUP BY len))"""


@query(STOP + " SELECT len, ROUND(stop_thresh, 6) AS stop_thresh, ROUND(stop_perr, 6) AS stop_perr, ROUND(stop_err, 6) AS stop_err FROM stops")
def q_stopping_curve(spark, sf):
    t, _ = evaluate.decoding_curve(views.fy(spark, sf), T, LENGTHS)
    return r6(evaluate.stopping_curve(t, T), "stop_thresh", "stop_perr", "stop_err")


@query(STOP + " SELECT ROUND(100 * avg(err), 4) AS audc, ROUND(100 * avg(abs(err_est - err) / greatest(err, 0.1)), 4) AS psae, ROUND(100 * avg(stop_err), 4) AS ausc, ROUND(100 * avg(abs(stop_err - stop_perr) / greatest(stop_err, 0.1)), 4) AS ssae FROM curve JOIN stops USING (len)")
def q_curve_metrics(spark, sf):
    t, c = evaluate.decoding_curve(views.fy(spark, sf), T, LENGTHS)
    m = evaluate.curve_metrics(c, evaluate.stopping_curve(t, T))
    return m.withColumns({x: F.round(x, 4) for x in m.columns})


@query(CURVE + """, s AS (SELECT trial % 6 AS session, len, avg(yerr) AS err, avg(perr) AS err_est FROM trials GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY len) - 1 AS pos FROM s) SELECT pos, count(*) AS n, ROUND(avg(err), 6) AS err, ROUND(avg(err_est), 6) AS err_est FROM p GROUP BY pos""")
def q_average_curves(spark, sf):
    t, _ = evaluate.decoding_curve(views.fy(spark, sf), T, LENGTHS)
    c = t.groupBy((F.col("trial") % 6).alias("session"), "len").agg(F.avg("yerr").alias("err"), F.avg("perr").alias("err_est"))
    return r6(evaluate.average_curves(c), "err", "err_est")


@query(with_views("fy") + " SELECT trial, max(s) FILTER (obj = 0) >= max(s) FILTER (obj <> 0) AS correct FROM (SELECT trial, obj, ROUND(sum(v), 9) AS s FROM fy GROUP BY ALL) GROUP BY trial")
def q_trial_correct(spark, sf):
    return evaluate.trial_correct(views.fy(spark, sf), T)
