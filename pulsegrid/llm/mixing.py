"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source gets a target number of words; its documents then should be taken target / size times on average. The whole part
of that is taken by every document. The fractional parts are rounded dependently: two documents of a source exchange words
until one of the two fractions is 0 or 1, with chances that leave each fraction as it is on average. What they exchange is
mass in words, not a count, so the words that a source gives stay at its target up to one unsettled document.

The pairing is a reduction tree. Documents are dealt out to small groups by a seeded hash; each group settles all its
documents but one by a walk over an array, and the unsettled ones of FAN groups meet in one group of the next level. Only
unsettled rows go on, so the levels shuffle n, n / FAN, n / FAN^2 ... short rows, and no task holds more than a group.

Long documents go first (over one `share`-th of their source and over twice its mean; then over half the mean), each class in a
tree of its own; what their rounding gives too much or too little is taken from the fractions of all shorter ones, which on
average leaves them as they are. So the last unsettled document of a source, whose rounding nothing can balance, is a short one
wherever the short ones can balance the long ones.

Rows that agree in source, doc_id and size are alike in the result, so they are counted first and dealt out as one entry with a
multiplicity; a group of copies of any size is one short row until the last step.

Defined cases: a null text has no words; documents without words are never taken; a null source is a source of its own and comes last; a null
doc_id is one more id; repeated rows return as often as they stand; an empty table gives an empty result; when no document has
a word all targets are 0; columns other than doc_id, text and the source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut

#: The white space that parts words.
SPACE = r"\x20\x09-\x0D"
FAN = 64
CHUNK = 4096
TREE = "pivot-tree"


def word_count(text: Column) -> Column:
    """Words of a text: each is replaced by one letter together with the white space around it."""
    one = F.regexp_replace(text, rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(one)).otherwise(0).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources + place: their order by code point, null last, without bringing them into one task."""
    s = cut(sources.orderBy(F.asc_nulls_last("source")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    parts = s.groupBy("_p").agg(F.count("*").alias("_n")).orderBy("_p").collect()  # a row a partition
    before, at = [0], 0
    for r in parts:
        before += [at] * (r["_p"] + 1 - len(before))
        before[-1] = at
        at += r["_n"]
    if not parts:
        return s.withColumn("place", F.lit(0).cast("long")).drop("_p", "_i")
    return s.withColumn("place", F.get(F.lit(before) if len(before) > 1 else F.array(F.lit(before[0])), F.col("_p")).cast("long") + F.col("_i")).drop("_p", "_i")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, ...) + target. The weights repeat over the sources in their order and share `total` times all sizes; a target
    stops at `most` times its source's size, and what is over is shared again by weight until none is above."""
    s = _ranked(sources)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = cut(s.withColumn("_w", w).withColumn("_cap", most * F.col("source_size")), "sources")
    whole = total * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:  # each round stops at least one more source: as many rounds as there are kinds of full sources
        full = F.col("_w") * level >= F.col("_cap")
        r = s.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if (r[0] or 0) == held or not r[2]:
            break
        held, level = r[0], (whole - (r[1] or 0.0)) / r[2]
    return s.withColumn("target", F.least("_cap", F.col("_w") * level)).drop("_w", "_cap")


def _chance(level: int, seed: int) -> Column:
    """A number in [0, 1) of an entry at a level."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "sid", "doc_id", "size"), F.lit(1 << 40)) / float(1 << 40)


def _walk(rows: Column) -> Column:
    """One group: rows (size, mass, u, doc_id) in order. Struct of what is unsettled and of the settled (doc_id, size, up)."""
    kind = "struct<size:bigint,mass:double,u:double,doc_id:bigint>"
    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast("array<struct<doc_id:bigint,size:bigint,up:boolean>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        h = acc["held"]
        a_up, a_down = F.least(h["size"] - h["mass"], x["mass"]), F.least(h["mass"], x["size"] - x["mass"])
        rises = x["u"] * (a_up + a_down) < a_down  # the held one takes a_up words from the next, or gives it a_down
        h_full, h_empty = rises & (h["size"] - h["mass"] <= x["mass"]), ~rises & (h["mass"] <= x["size"] - x["mass"])
        settles = h_full | h_empty  # else the next one settles
        left = F.when(rises, F.when(h_full, x["mass"] - a_up).otherwise(h["mass"] + a_up)).otherwise(F.when(h_empty, x["mass"] + a_down).otherwise(h["mass"] - a_down))
        who = F.when(settles, F.struct(h["doc_id"].alias("doc_id"), h["size"].alias("size"), rises.alias("up"))).otherwise(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (~rises).alias("up")))
        keep = F.when(settles, x).otherwise(h)
        keep = F.struct(keep["size"].alias("size"), left.alias("mass"), keep["u"].alias("u"), keep["doc_id"].alias("doc_id"))
        return F.when(h.isNull(), F.struct(x.cast(kind).alias("held"), acc["done"].alias("done"))).otherwise(F.struct(keep.cast(kind).alias("held"), F.concat(acc["done"], F.array(who)).alias("done")))

    return F.aggregate(rows, start, step)


def pivotal_rounding(entries: DataFrame, seed: int = 0, fan: int = FAN) -> DataFrame:
    """sid, doc_id, size, up of entries (sid, doc_id, size, mass; one row a key, 0 < mass < size): every entry ends at mass 0 or size,
    each with its own mass on average, the sum of a source off by less than one entry."""
    spark = entries.sparkSession
    e = cut(entries, TREE)
    counts = cut(e.groupBy("sid").agg(F.count("*").alias("n")), TREE)
    most = counts.agg(F.max("n")).first()[0] or 0
    groups = F.greatest(F.ceil(F.col("n") / fan), F.lit(1))
    e = e.join(counts, "sid").withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), groups)).drop("n")
    level, left, done = 0, max(1, -(-most // fan)), []
    while most:
        row = F.struct((-F.col("size")).alias("order"), F.col("doc_id"), F.col("mass"), _chance(level, seed).alias("u"), F.col("size"))
        rows = F.sort_array(F.collect_list(row))  # about `fan` entries, dealt by a hash of unlike keys
        rows = F.transform(rows, lambda x: F.struct(x["size"], x["mass"], x["u"], x["doc_id"]))
        w = cut(e.groupBy("sid", "g").agg(_walk(rows).alias("w")).select("sid", "g", "w.held", "w.done"), TREE)
        done.append(w.select("sid", F.explode("done").alias("d")).select("sid", "d.*"))
        e = w.select("sid", F.floor(F.col("g") / fan).alias("g"), "held.*")
        level += 1
        if left == 1:
            break
        left = -(-left // fan)
    if not most:
        return spark.createDataFrame([], "sid bigint, doc_id bigint, size bigint, up boolean")
    # whatever is unsettled falls to one side by chance
    out = e.select("sid", "doc_id", "size", (_chance(level, seed) * F.col("size") < F.col("mass")).alias("up"))
    for d in done:
        out = out.unionByName(d)
    return out


def mix_plan(docs: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, share: int = 1000, seed: int = 42) -> DataFrame:
    """One row for rows alike: source, doc_id, size, source_size, target, rows, base (copies of every row), extra (how many of the rows get one
    more)."""
    size = word_count(F.coalesce(F.col("text"), F.lit("")))
    kinds = docs.select(F.col(source_col).cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    kinds = cut(kinds, "kinds")
    sources = source_targets(kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows")), weights, total, most)
    sources = cut(sources.withColumnRenamed("place", "sid"), "sources")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = sources.select(F.col("source").alias("_s"), "sid", "source_size", "source_rows", "target", F.floor(r).alias("base"), (r - F.floor(r)).alias("f"))
    d = cut(kinds.join(s, kinds.source.eqNullSafe(s._s)).drop("_s"), "kinds")

    mean = F.col("source_size") / F.col("source_rows")
    bounds = [F.greatest(F.col("source_size") / share, 2 * mean), mean / 2]
    left, cols, out = d, ["source", "sid", "doc_id", "size", "source_size", "target", "rows", "base", "f", "extra"], None
    for k, bound in enumerate([*bounds, None]):
        now, left = (left, None) if bound is None else (left.where(F.col("size") > bound), left.where(F.col("size") <= bound))
        if out is not None:  # what the longer ones took too much or too little
            room = now.unionByName(left) if left is not None else now
            room = room.groupBy("sid").agg(F.sum(F.col("size") * F.col("rows")).alias("_room"))
            off = out.groupBy("sid").agg(F.sum(F.col("size") * (F.col("extra") - F.col("rows") * F.col("f"))).alias("_off"))
            fix = cut(room.join(off, "sid").where("_room > 0").select("sid", (F.col("_off") / F.col("_room")).alias("_by")), "moved")
            now = now.join(fix, "sid", "left").withColumn("_f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f") - F.coalesce("_by", F.lit(0.0))))).drop("_by")
        else:
            now = now.withColumn("_f", F.col("f"))
        got = cut(_rounded(now, seed + k).select(*cols), "rounded")
        out = got if out is None else out.unionByName(got)
    return out.drop("sid", "f")


def _rounded(d: DataFrame, seed: int) -> DataFrame:
    """d + extra: of `rows` rows, each with fraction _f, the whole part of rows * _f, and one more for those that the tree lifts."""
    d = d.withColumn("_k", F.floor(F.col("rows") * F.col("_f"))).withColumn("_q", F.col("rows") * F.col("_f") - F.col("_k"))
    d = cut(d, "fractions")
    some = (F.col("size") > 0) & (F.col("_q") > 1e-12) & (F.col("_q") < 1 - 1e-12)
    ups = pivotal_rounding(d.where(some).select("sid", "doc_id", "size", (F.col("_q") * F.col("size")).alias("mass")), seed)
    ups = ups.where("up").select(F.col("sid").alias("_sid"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"))
    whole = F.col("_k") + F.when(~some & (F.col("_q") >= 0.5), 1).otherwise(0)
    j = d.join(ups, (d.sid == ups._sid) & d.doc_id.eqNullSafe(ups._id) & (d.size == ups._size), "left")
    return j.withColumn("extra", F.when(F.col("_sid").isNotNull(), F.col("_k") + 1).otherwise(whole)).drop("_k", "_q", "_sid", "_id", "_size")


def planned_rows(plan: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row for each document, from the plan alone. Many rows alike come out of
    several tasks."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))
    p = plan.withColumn("_c", F.explode(parts))
    many = p.where(F.col("rows") > CHUNK).repartition("doc_id", "_c")
    p = p.where(F.col("rows") <= CHUNK).unionByName(many)
    first = F.col("_c") * CHUNK
    p = p.withColumn("_i", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("rows")) - 1)))
    copies = F.col("base") + (F.col("_i") < F.col("extra")).cast("long")
    return p.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, plan: DataFrame, source_col: str = "source") -> DataFrame:
    """The mixture itself: rows of docs, as often as the plan takes them. Of rows that are alike in source, doc_id and size one stands for all."""
    own = docs.columns
    d = docs.withColumn("_size", word_count(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates([source_col, "doc_id", "_size"])
    p = plan.select(F.col("source").alias("_s"), F.col("doc_id").alias("_id"), F.col("size").alias("_n"), (F.col("rows") * F.col("base") + F.col("extra")).alias("_times")).where("_times > 0 and _n > 0")
    j = d.join(p, d[source_col].eqNullSafe(p._s) & d.doc_id.eqNullSafe(p._id) & (d._size == p._n))
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*own)


def mixing_query(spark, sf_dir: str) -> DataFrame:
    return planned_rows(mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
