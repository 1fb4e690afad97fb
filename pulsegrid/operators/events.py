"""Event coding of stimulus levels. Input: keys + samp, obj, level; output adds evt (name) and v (0/1, or a level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of bit patterns.
PATTERNS = {"re": "01", "fe": "10", "short": "010", "long": "0110"}


def code_column(evt: str, keys: list[str], samp: str = "samp", obj: str = "obj", level: str = "level") -> Column:
    """The coded value of one event type at each row. nt<evt> and any<evt> look at all objects of a sample and are built by
    code_events from the plain code."""
    w = Window.partitionBy(*keys, obj).orderBy(samp)
    now = F.col(level)
    if evt in ("1", "flash"):
        return (now == 1).cast("int")
    if evt == "0":
        return (now == 0).cast("int")
    if evt == "raw":
        return now
    if evt == "grad":
        return F.coalesce(now - F.lag(now).over(w), F.lit(0))
    if evt == "diff":
        return F.coalesce((now != F.lag(now).over(w)).cast("int"), F.lit(0))
    if evt == "onset":
        return _onset(now, w)
    if evt == "rest":
        return (F.max(F.abs(now)).over(Window.partitionBy(*keys, samp)) == 0).cast("int")
    bits = PATTERNS.get(evt, evt)
    if not bits or set(bits) - {"0", "1"}:
        raise ValueError(f"unknown event type {evt!r}")
    hit = F.lit(True)
    for k, bit in enumerate(reversed(bits)):
        past = now if k == 0 else F.lag(now, k).over(w)
        hit = hit & F.coalesce((past > 0) if bit == "1" else (past == 0), F.lit(False))
    return hit.cast("int")


def _onset(now: Column, w) -> Column:
    """1 while the running count of active samples is 1: from the first active sample to the next one."""
    count = F.sum((now > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (count == 1).cast("int")


def code_events(df: DataFrame, evts: list[str], keys: list[str]) -> DataFrame:
    """keys, samp, obj, evt, v for each event type, as rows."""
    plain = {e: e for e in evts if not e.startswith(("nt", "any"))}
    base = {e: (e[2:] if e.startswith("nt") else e[3:]) for e in evts if e not in plain}
    d = df
    for e in dict.fromkeys([*plain, *base.values()]):
        d = d.withColumn(f"_e_{e}", code_column(e, keys))
    here = Window.partitionBy(*keys, "samp")
    for e, b in base.items():
        some = F.max(f"_e_{b}").over(here)
        d = d.withColumn(f"_e_{e}", ((F.col(f"_e_{b}") == 0) & (some == 1)).cast("int") if e.startswith("nt") else some)
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("evt"), F.col(f"_e_{e}").cast("double").alias("v")) for e in evts]))
    return d.select(*keys, "samp", "obj", rows.alias("_r")).select(*keys, "samp", "obj", "_r.evt", "_r.v")


def event_counts(coded: DataFrame, keys: list[str]) -> DataFrame:
    return coded.groupBy(*keys, "evt", "obj").agg(F.sum("v").alias("n"))
