"""Host-level quality rules.

Each document gets counts and rule failures; failures are summed by host (the column `source`), each host's failure
rate is shrunk towards the rate of all hosts with a beta prior that is fitted to the hosts themselves (method of
moments), and the host's verdict is joined back to its documents.

Defined cases: a null text counts as empty (no words, base_failed); a null host has no host verdict, so only the base
rule decides; repeated rows count and return as often as they stand; an empty table gives an empty result; columns
other than doc_id, text and the host are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, map_rows

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

STATS = "doc_id bigint, th bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    first: dict[tuple, int] = {}
    marked: set[int] = set()
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(g, i)
        if j != i:
            marked.update((i, i + 1, i + 2, j, j + 1, j + 2))
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, len(marked)


def _stats():
    def fn(c: dict) -> dict:
        rows = [text_stats(t or "") for t in c["text"]]
        n, chars, sym, dup, rep = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        return {
            "doc_id": c["doc_id"], "th": c["th"], "host": c["host"], "n_words": n, "word_chars": chars, "n_symbols": sym, "n_dup_lines": dup, "n_repeat_words": rep,
            "base_failed": [a < 50 or 100 * r > 50 * a for a, r in zip(n, rep, strict=True)],
        }

    return fn


def host_quality(docs: DataFrame, host_col: str = "source", max_host_rate: float = 0.5, min_prior: float = 1.0, max_prior: float = 1000.0) -> DataFrame:
    """One row per document: its counts, th (xxhash64 of the text), base_failed, host_rate (shrunk failure rate) and kept.

    A document fails by the base rule, or by the symbol rule (over one symbol in three words); failing documents are summed by
    host. A host is rejected when that share, shrunk, is above max_host_rate. The prior's weight stays within
    min_prior..max_prior documents (hosts that are all alike would make it endless).
    """
    s = cut(map_rows(docs.select("doc_id", F.xxhash64("text").alias("th"), F.col(host_col).cast("string").alias("host"), "text"), _stats, STATS), "quality")
    failed = F.col("base_failed") | (3 * F.col("n_symbols") > F.col("n_words"))
    hosts = s.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("bad"))
    hosts = cut(hosts, "hosts")
    rate = F.col("bad") / F.col("n")
    p = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    mean = (p["bad"] or 0) / p["n"] if p["n"] else 0.0
    spread = max((p["v"] or 0.0) - mean * (1 - mean) * (p["inv"] or 0.0), 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, min_prior), max_prior)
    verdicts = hosts.select("host", ((F.col("bad") + mean * weight) / (F.col("n") + weight)).alias("host_rate"))
    known, lone = s.where("host is not null").join(verdicts, "host", "left"), s.where("host is null").withColumn("host_rate", F.lit(None).cast("double"))
    out = known.select(*lone.columns).union(lone)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate))


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return host_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
reps AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS i FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
dups AS (SELECT rid, sum(c - 1)::BIGINT AS n_dup_lines FROM (SELECT rid, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
s AS (SELECT w.rid, w.doc_id, w.host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN reps USING (rid) LEFT JOIN dups USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR 3 * n_symbols > n_words) AS bad FROM f WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 1.0), 1000.0) AS weight FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((bad + mean * weight) / (n + weight), 0) <= 0.5 AS kept, ROUND((bad + mean * weight) / (n + weight), 6) AS host_rate
FROM f CROSS JOIN q LEFT JOIN h USING (host)
"""
