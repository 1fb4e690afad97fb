"""The given tables as recordings, stimulus events, clocks, markers and scores.

Every view keeps a unique order: ties of time are broken by the table's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.shared import table

#: Event types in the order of their object numbers.
OBJECTS = ["click", "error", "purchase", "signup", "view"]


def millis(col: str):
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def stim_events(spark: SparkSession, sf: str) -> DataFrame:
    """session, event_id, ts (ms), obj, state."""
    e = table(spark, sf, "events")
    obj = F.array_position(F.array(*[F.lit(x) for x in OBJECTS]), F.col("event_type")).cast("int") - 1
    return e.select((F.col("user_id") % 8).alias("session"), "event_id", millis("ts").alias("ts"), obj.alias("obj"), (F.col("value").cast("long") % 2).cast("int").alias("state"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """session, samp, trial (25 samples each), x (all channels)."""
    e = table(spark, sf, "embeddings")
    samp = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    d = e.select(F.col("label").alias("session"), samp.alias("all_samp"), F.col("embedding").cast("array<double>").alias("x"))
    return d.select("session", F.floor(F.col("all_samp") / 25).cast("int").alias("trial"), (F.col("all_samp") % 25).cast("int").alias("samp"), "x")


def long_signal(spark: SparkSession, sf: str) -> DataFrame:
    """session, trial, samp, ch, v."""
    return signal(spark, sf).select("session", "trial", "samp", F.posexplode("x").alias("ch", "v"))


def samples(spark: SparkSession, sf: str, rows: int = 1_000_000) -> DataFrame:
    """session, samp, x: a long recording of four channels. Rows are numbered within their day and moved by the rows of the days before, so no task sorts a
    whole session, and none takes much more than `rows` rows."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("session"), *[f"l_{c}" for c in ("shipdate", "orderkey", "linenumber", "partkey", "suppkey", "quantity", "extendedprice", "discount", "tax")])
    days = li.groupBy("session", "l_shipdate").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("session").orderBy("l_shipdate")) - F.col("_n")
    days = days.select(F.col("session").alias("_s"), F.col("l_shipdate").alias("_day"), before.alias("_before"))  # a row a session and day
    parts = -(-li.count() // rows)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li = li.repartition(parts, "session", "l_shipdate")
    w = Window.partitionBy("session", "l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1e4, F.col("l_discount"), F.col("l_tax"))
    li = li.select("session", "l_shipdate", (F.row_number().over(w) - 1).alias("_no"), x.alias("x"))
    j = li.join(F.broadcast(days), F.col("session").eqNullSafe(F.col("_s")) & F.col("l_shipdate").eqNullSafe(F.col("_day")))
    return j.select("session", (F.col("_no") + F.col("_before")).cast("int").alias("samp"), "x")


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """session, seq (unique order of ties), ts (ms), kind."""
    kind = F.when(F.col("o_orderstatus") == "F", "NEWTARGET").when(F.col("o_orderstatus") == "O", "SELECTION").otherwise("MODECHANGE")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 16).alias("session"), F.col("o_orderkey").alias("seq"), millis("o_orderdate").alias("ts"), kind.alias("kind"))


def clients(spark: SparkSession, sf: str) -> DataFrame:
    """client, seq, sts (server ms), cts (client ms), obj: two clocks of one event."""
    d = stim_events(spark, sf)
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 16).alias("client"))
    return d.join(e, "event_id").select("client", F.col("event_id").alias("seq"), F.col("ts").alias("sts"), (F.col("ts") + (F.col("event_id") * 7919) % 97).alias("cts"), "obj")


def fy(spark: SparkSession, sf: str) -> DataFrame:
    """trial, obj, samp, v: output scores; 0 means inactive."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "l_discount")
    return li.select(F.col("l_suppkey").alias("trial"), (F.col("l_linenumber") - 1).alias("obj"), (F.row_number().over(w) - 1).alias("samp"), ((F.col("l_quantity") - 25) / 10).alias("v"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """session, seq, ts, yest, perr."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), millis("ts").alias("ts"), (F.col("event_id") % 7).cast("int").alias("yest"), (F.floor((F.col("value") * 100) % 100) / 100).alias("perr"))


#: The same views as SQL, to stand in a WITH.
SQL = {
    "stim_events": """stim_events AS (SELECT user_id % 8 AS session, event_id, epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS obj, CAST(trunc(value) AS BIGINT) % 2 AS state FROM events)""",
    "signal": """signal AS (SELECT session, all_samp // 25 AS trial, all_samp % 25 AS samp, x FROM
  (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS all_samp, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))""",
    "long_signal": """long_signal AS (SELECT session, trial, samp, unnest(range(len(x))) AS ch, unnest(x) AS v FROM signal)""",
    "samples": """samples AS (SELECT l_suppkey % 16 AS session, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS samp,
  [l_quantity, l_extendedprice / 1e4, l_discount, l_tax] AS x FROM lineitem)""",
    "markers": """markers AS (SELECT o_custkey % 16 AS session, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'NEWTARGET' WHEN 'O' THEN 'SELECTION' ELSE 'MODECHANGE' END AS kind FROM orders)""",
    "clients": """clients AS (SELECT user_id % 16 AS client, event_id AS seq, epoch_us(ts) // 1000 AS sts, epoch_us(ts) // 1000 + (event_id * 7919) % 97 AS cts,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS obj FROM events)""",
    "fy": """fy AS (SELECT l_suppkey AS trial, l_linenumber - 1 AS obj,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount) - 1 AS samp, (l_quantity - 25) / 10 AS v FROM lineitem)""",
    "predictions": """predictions AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) // 1000 AS ts, event_id % 7 AS yest, floor((value * 100) % 100) / 100 AS perr FROM events)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
