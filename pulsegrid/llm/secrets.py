"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns. The hash of every candidate value (base ones and
further credential shapes) is counted over the whole corpus by distinct owner (the column `source`) and distinct
repository (owner and language). A value that many owners or many repositories hold is a copied example; one that few
repositories of a single owner hold looks live. Further credential shapes are added to the spans when their value looks live; base spans always stay.

Defined cases: a null text counts as empty; a null owner or repository counts as one more owner of its own; repeated rows
return as often as they stand and do not raise a value's frequency; a document without candidates has empty spans; an
empty table gives an empty result; columns other than doc_id, text, owner and language are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut

#: The base patterns, in the order in which kinds are listed. [0-9a-f]{16,} and AKIA[A-Z0-9]{14,} match what
#: the shorter patterns match after the length rule, because a run that is too short holds no longer one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further shapes: upper-case hex keys, prefixed keys, bearer tokens. They are spans only if their value looks live.
TOKEN = r"[0-9A-F]{32,}|(?:ghp|gho|glpat|xox[abp]|sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|[Bb]earer\x20+[A-Za-z0-9._~+/=-]{16,}"
KINDS = ["assign", "access", "hex", "token"]
BLOCK = 256
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:bigint>>"


def _spans(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches of pattern whose group has at least so many characters. The text between matches gives
    their places: length() counts code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("val"))
    cut_up = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda b: F.slice(r, b * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.flatten(F.transform(F.array(rows), cut_up))  # bound to a name, the matches are found once
    none = F.array().cast(SPAN)
    found_to = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.xxhash64(x["val"]).alias("value")))
        out = F.when(F.length(x["val"]) >= least, F.concat(acc["out"], one.cast(SPAN))).otherwise(acc["out"])
        return F.struct(F.coalesce(stop, begin).alias("at"), out.alias("out"))

    # each step of an aggregate copies what it holds: so lists of up to BLOCK spans grow one by one, then a list of those lists
    walk = F.aggregate(blocks, F.array(found_to(F.lit(0).cast("long"))), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, found_to(F.element_at(acc, -1)["at"]), step))))
    return F.when(text.rlike(pattern), F.flatten(F.transform(walk, lambda x: x["out"]))).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "lang", example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example. A value that example_owners or more
    distinct owners, or example_repos or more distinct repositories, hold is an example, others look live."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), t.alias("text"))
    d = d.select("doc_id", "owner", "repo", F.concat(_spans(F.col("text"), 0, ASSIGN, 2, 12), _spans(F.col("text"), 1, ACCESS), _spans(F.col("text"), 2, HEX)).alias("base"), _spans(F.col("text"), 3, TOKEN).alias("more"))
    d = cut(d.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    some = F.size("base") + F.size("more") > 0
    held = d.where(some).select("rid", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["value"]))).alias("value"))
    owners = held.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    owners = owners.select("value", ((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)).alias("example"))
    live = held.join(owners, "value").groupBy("rid").agg(F.collect_set(F.when(~F.col("example"), F.col("value"))).alias("live"), F.sum(F.col("example").cast("long")).alias("n_example"))
    cols = ["doc_id", "base", "more", "live", "n_example"]
    out = d.where(some).join(live, "rid").select(*cols).union(d.where(~some).select("doc_id", "base", "more", F.array().cast("array<bigint>").alias("live"), F.lit(0).cast("long").alias("n_example")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    covered = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    extra = F.filter("more", lambda s: F.array_contains("live", s["value"]) & ~covered(s))
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", extra)).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_example")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
