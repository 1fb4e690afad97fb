"""Near-duplicate detection with one-permutation hashing.

Each document's word shingles are hashed once; the top bits of the hash pick a bin and each bin keeps its least value.
Empty bins are filled by optimal densification: bin i probes other bins by a hash of (i, attempt) until it meets a full
one, so that every bin of two documents agrees with the probability of their Jaccard similarity. Bins form bands;
documents that agree on a band share a bucket. Documents with one set of shingles form one class first, so copies are
never paired.

Candidates are stars, so their number is linear in a bucket's size: each bucket pairs its members with one centre, the one
that shares most buckets with others (the text that a group of copies was made from, as a rule). Confirmed pairs give
components. A bucket that still holds several components pairs its outsiders (members outside its largest component)
with the members of other components once more; pairs whose sketches differ by too much to reach the similarity are
dropped inside the join. So no link between different texts of a bucket is lost, while the pairs inside a component,
whose number would be the square of a group, are never made.

A sketch is 128 bits, and 1,024 where outsiders are paired, so that texts which share much but too little (a long passage, say)
are told apart there. Small sets toggle one bit for each shingle: sets differ in at least as many shingles as bits, so this
test is exact. In the shorter sketch large sets keep one bit of each bin; the limit is 4.5 standard deviations beyond what the similarity
gives. A pair of similarity s shares no bucket with probability (1 - s^rows)^bands (3e-6 at 0.8).

Defined cases: a null or empty text has no shingles, stands alone; a null doc_id stands alone with a null component; rows
that repeat a doc_id are separate documents with one id; ties go to the smaller doc_id; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import connected_components, cut, forget, hashed_words, map_batches, maybe_among, mix, ship, text_bytes

SLICE, SMALL, LIMIT, FINE = 512, 200, 31, 16
SIGNATURES = "doc_id bigint, th bigint, n_shingles bigint, s1 bigint, s2 bigint, k1 bigint, k2 bigint, fine array<bigint>, bands array<bigint>"


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text. A text of fewer words is one shingle."""
    data, at = text_bytes(column)
    starts, w = hashed_words(data, at)
    edge = np.searchsorted(starts, at).tolist()
    flat = np.full(max(0, len(w) - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            flat = mix(flat * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(flat)])
    out = []
    for a, b in zip(edge, edge[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(flat[a : b - width + 1]))
        else:
            got = np.full(min(1, b - a), b - a, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    got = mix(got * np.uint64(0x9E3779B97F4A7C15) + w[k : k + 1])
            out.append(got)
    return out


class OnePermutation:
    """Densified signatures, bands and sketches of sets of sorted hashes."""

    ATTEMPTS = 512

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.probes = self._probes(1)

    def _probes(self, first: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            tries = np.arange(first, first + self.ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
            return (mix(np.arange(self.bins, dtype=np.uint64) * np.uint64(0x100000001B3) + tries) % np.uint64(self.bins)).astype(np.int64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Of a non-empty sorted set: the least hash of each bin. A bin is a range of hashes, so it is its first."""
        at = ((s >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        sig, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        sig[at[first]] = s[first]
        full[at[first]] = True
        todo, attempt, probes = np.flatnonzero(~full), 0, self.probes
        while len(todo):
            if attempt and attempt % self.ATTEMPTS == 0:
                probes = self._probes(attempt + 1)
            tried = probes[attempt % self.ATTEMPTS :][:8, todo]
            hit = full[tried]
            which = hit.argmax(0)
            done = hit[which, np.arange(len(todo))]
            sig[todo[done]] = sig[tried[which[done], np.flatnonzero(done)]]
            todo, attempt = todo[~done], attempt + len(tried)
        return sig

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        grid, key = sig.reshape(self.bands, self.rows), self.salt.copy()
        with np.errstate(over="ignore"):
            for k in range(self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
        return key.view(np.int64)

    def sketch(self, s: np.ndarray, sig: np.ndarray) -> list[int]:
        bits = np.bincount((mix(s) >> np.uint64(57)).astype(np.int64), minlength=128) & 1 if len(s) < SMALL else sig[:128] & np.uint64(1)
        return np.packbits(bits.astype(bool)).view(np.int64).tolist()

    @staticmethod
    def fine_sketch(s: np.ndarray) -> np.ndarray:
        """64 * FINE bits, one toggled by each shingle."""
        return np.packbits((np.bincount((mix(s + np.uint64(5)) >> np.uint64(54)).astype(np.int64), minlength=64 * FINE) & 1).astype(bool)).view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = OnePermutation(bands, rows)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                n, s1, s2, k1, k2, fine, keys, sizes = [], [], [], [], [], [], [], [0]
                for s in shingle_sets(part.column(2), width):
                    n.append(len(s))
                    sizes.append(sizes[-1] + (bands if len(s) else 0))
                    if not len(s):
                        for x in (s1, s2, k1, k2):
                            x.append(None)
                        continue
                    sig = one.signature(s)
                    with np.errstate(over="ignore"):
                        s1.append(int(s.sum().view(np.int64)))
                        s2.append(int(mix(s + np.uint64(77)).sum().view(np.int64)))
                    x, y = one.sketch(s, sig)
                    k1.append(x)
                    k2.append(y)
                    with np.errstate(over="ignore"):
                        fine.append(one.fine_sketch(s))
                    keys.append(one.band_keys(sig))
                at = np.array(sizes)
                lists = [pa.ListArray.from_arrays(pa.array(a, pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for a, x in ((at // bands * FINE, fine), (at, keys))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, s1, s2, k1, k2)], *lists], names=["doc_id", "th", "n_shingles", "s1", "s2", "k1", "k2", "fine", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                sets = shingle_sets(part.column(1), width)
                at = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["cid", "hashes"])

    return run


def _may_link(similarity: int, a: str, b: str):
    """Whether two members may be similar: by their sizes and their sketches."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    unlike = sum(F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in ("k1", "k2"))
    share = similarity / 100
    p = (1 - share) / 2  # of one bit of a bin to differ
    limit = LIMIT if similarity == 80 else round(128 * p + 5.3 * (128 * p * (1 - p)) ** 0.5)
    exact = (n < SMALL) & (m < SMALL)
    near = F.when(exact, (100 + similarity) * unlike <= (100 - similarity) * (n + m)).when((n >= SMALL) & (m >= SMALL), unlike <= limit).otherwise(True)
    return (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & near


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rid and th (xxhash64 of the text) of each row. Linked: 100 * intersection >=
    similarity * union."""
    ship(docs.sparkSession)
    given = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sig = map_batches(given, _signatures(width, bands, rows), SIGNATURES)
    sig = cut(sig.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    whole = sig.where("n_shingles > 0 and doc_id is not null")
    same = ["s1", "s2", "n_shingles"]
    classes = cut(whole.groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("rid").alias("cid")), "classes")
    heads = classes.select("cid").join(sig, F.col("cid") == F.col("rid")).select("cid", "doc_id", "th", F.col("n_shingles").alias("n"), "k1", "k2", "fine", "bands")

    flat = heads.select("cid", "n", "k1", "k2", F.explode("bands").alias("key"))
    many = cut(flat.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    some = maybe_among(flat, many.select("key"), F.col("key"))
    members = cut(some.join(many, "key"), "buckets")
    some.bits.destroy()
    fame = members.groupBy("cid").agg(F.sum("size").alias("fame"))
    centres = members.select("key", "cid").join(fame, "cid").groupBy("key").agg(F.min(F.struct(-F.col("fame"), "cid"))["cid"].alias("centre"))
    about = members.dropDuplicates(["cid"]).select(F.col("cid").alias("centre"), F.struct("n", "k1", "k2").alias("c"))
    stars = members.select("key", "cid", F.struct("n", "k1", "k2").alias("m")).join(centres, "key").where("cid <> centre").join(about, "centre")
    pairs = cut(stars.where(_may_link(similarity, "m", "c")).select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct(), "stars")
    links = cut(_confirmed(pairs, heads, given, width, similarity), "links")
    parts = cut(connected_components(links), "parts")

    placed = members.join(parts, members.cid == parts.node, "left").select("key", "cid", F.coalesce("component", "cid").alias("component"), F.struct("n", "k1", "k2").alias("m"))
    placed = cut(placed, "placed")
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    tops = shares.groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", "top")
    fine = heads.select("cid", F.struct(*[F.get("fine", F.lit(i)).alias(f"f{i}") for i in range(FINE)]).alias("fine"))
    split = placed.join(tops, "key").join(fine, "cid")
    out = split.where("component <> top").select("key", F.col("cid").alias("o"), F.col("component").alias("of"), F.col("m").alias("c"), F.col("fine").alias("fine_o"))
    unlike = sum(F.bit_count(F.col(f"fine.f{i}").bitwiseXOR(F.col(f"fine_o.f{i}"))) for i in range(FINE))
    few = (100 + similarity) * unlike <= (100 - similarity) * (F.col("m.n") + F.col("c.n"))
    rest = split.join(out, "key").where("component <> of and (component = top or cid < o)").where(_may_link(similarity, "m", "c") & few)
    rest = rest.select(F.least("cid", "o").alias("a"), F.greatest("cid", "o").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    rest = cut(rest, "rest")
    more = cut(_confirmed(rest, heads, given, width, similarity), "links")
    forget(members, placed, many)
    # the new links join components: one more walk over their heads
    bridges = more.join(parts.alias("pa"), F.col("a") == F.col("pa.node"), "left").join(parts.alias("pb"), F.col("b") == F.col("pb.node"), "left").select(F.coalesce("pa.component", "a").alias("a"), F.coalesce("pb.component", "b").alias("b"))
    over = cut(connected_components(bridges.distinct()), "parts")
    placed = classes.join(parts, classes.cid == parts.node, "left").select(*same, "least", F.coalesce("component", "cid").alias("part"))
    ids = placed.join(over, placed.part == over.node, "left").select(*same, "least", F.coalesce("component", "part").alias("component"))
    tops = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.join(tops, "component").select(*same, "component_id")
    linked = whole.join(ids, same).select("doc_id", "n_shingles", "component_id", "rid", "th")
    lone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "rid", "th")
    return linked.union(lone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "rid", "th")


def _confirmed(pairs: DataFrame, heads: DataFrame, given: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Only texts of their classes are read again and moved."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    needed = heads.join(wanted, "cid", "left_semi").select("cid", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    needed = cut(needed, "wanted")
    few = maybe_among(given, needed.select("t"), F.col("th"))
    texts = few.join(needed, (F.col("th") == F.col("t")) & (F.col("doc_id") == F.col("d"))).select("cid", "text")
    sets = cut(map_batches(texts, _sets(width), "cid bigint, hashes array<bigint>").dropDuplicates(["cid"]), "sets")
    few.bits.destroy()
    x = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha"))
    y = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(x, "a").join(y, "b").where(100 * both >= similarity * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def near_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT rid, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
k AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM k JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(rid, top) AS (SELECT rid, rid FROM w UNION SELECT b.b, r.top FROM reach r JOIN both_ways b ON r.rid = b.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, w.doc_id = min(t.doc_id) AS kept
FROM w LEFT JOIN n ON n.rid = w.rid JOIN reach r ON r.rid = w.rid JOIN w t ON t.rid = r.top GROUP BY w.rid, w.doc_id, n.n
"""
