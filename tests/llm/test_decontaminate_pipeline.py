import random

import numpy as np
import pyarrow as pa

from pulsegrid.llm import decontaminate

rng = random.Random(4)
COMMON = "the of and to in is it that for on with as".split()


def words(n, stem):
    return [rng.choice(COMMON) if rng.random() < 0.4 else f"{stem}{rng.randrange(3000)}" for _ in range(n)]


ITEMS = [(i, " ".join(words(40, "q"))) for i in range(12)]


def fixture():
    rows, leaks = [], set()
    for d in range(120):
        w = words(rng.randint(5, 300), "d")
        if d % 6 == 0:
            i = rng.randrange(12)
            item = ITEMS[i][1].split()
            if d % 12 == 0:  # a paraphrase: a quarter of the words replaced, but not the rare ones
                for k in range(len(item)):
                    if item[k] in COMMON and rng.random() < 0.6:
                        item[k] = rng.choice(COMMON)
            at = rng.randrange(len(w))
            w[at:at] = item
            leaks.add((d, i))
        rows.append((d, " ".join(w)))
    return rows, leaks


def test_leaks_are_found_and_clean_documents_left(spark):
    rows, leaks = fixture()
    rows += [(500, None), (501, ""), (502, "one"), (503, ITEMS[3][1].upper() + "!"), (None, ITEMS[4][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, scores int")
    bench = spark.createDataFrame([*ITEMS, (None, "x y z " * 9), (99, None), (98, "too short")], "item_id bigint, text string")
    got = decontaminate.benchmark_leaks(df, bench).select("doc.doc_id", "doc.scores", "item_ids", "contaminated").collect()
    assert len(got) == len(rows) and {r.scores for r in got} == {1}
    found = {(r.doc_id, i) for r in got for i in r.item_ids}
    assert found == leaks | {(503, 3), (None, 4)}
    assert decontaminate.benchmark_leaks(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.benchmark_leaks(df, bench.limit(0)).collect())


def test_all_copies_are_found_in_a_large_benchmark(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"v{r.randrange(20_000)}" for _ in range(r.randint(15, 59)))) for i in range(3000)]
    rows = []
    for d in range(300):
        w = [f"v{r.randrange(20_000)}" for _ in range(200)]
        at = r.randrange(200)
        w[at:at] = items[d * 10][1].split()
        rows.append((d, " ".join(w)))
    got = decontaminate.benchmark_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id: r.item_ids for r in got.select("doc.doc_id", "item_ids").collect()} == {d: [d * 10] for d in range(300)}


def test_items_of_common_or_few_words_are_found(spark):
    r = random.Random(5)
    common = [f"c{i}" for i in range(20)]
    items = [(1, " ".join(r.choice(common) for _ in range(30))), (2, "Who wrote it?"), (3, "c1"), (4, "...")]
    rows = [(d, " ".join(r.choice(common[2:]) for _ in range(20)) + f" x{d}") for d in range(80)]
    rows += [(100, "c2 c3 " + items[0][1] + " c4"), (101, "c5, who WROTE it c6"), (102, "who else wrote it"), (103, "it who wrote"), (104, "c1"), (105, "who wrote"), (106, "it")]
    got = decontaminate.benchmark_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {r.doc_id: r.item_ids for r in got.select("doc.doc_id", "item_ids").where("contaminated").collect()}
    assert found == {100: [1, 3] if "c1" in items[0][1].split() else [1], 101: [2], 104: [3]}


def test_lcs_by_bits():
    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    for _ in range(50):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 80))] for _ in "ab")
        places = {}
        for i, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << i
        assert decontaminate.lcs(places, len(a), b) == plain(a, b)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c
    from pulsegrid.llm import bpe, lines, minhash, quality

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    a = c.quality_rules(spark, docs, small)
    kept = {r.doc_id for r in quality.host_quality(docs).where("kept").collect()}
    assert {r.doc_id for r in a.collect()} == kept and a.columns == docs.columns
    assert all(r.text == rows[r.doc_id].text for r in a.collect())
    some = docs.where("doc_id < 60")
    b = c.line_dedup(spark, some, small)
    gone = lines.brute_removed(sorted((r.doc_id, r.text) for r in some.collect()))
    for r in b.collect():
        left = [x for i, x in enumerate(rows[r.doc_id].text.split("\n")) if i not in set(gone.get(r.doc_id, []))]
        assert r.text == "\n".join(left) and r.n_chars == len(r.text)
    d = c.near_dedup(spark, some, small).collect()
    sets = {i: set(minhash.shingle_sets(pa.array([r.text], pa.string()), 5)[0].tolist()) for i, r in rows.items() if i < 60}
    for r in d:
        assert not any(sets[r.doc_id] and 100 * len(sets[r.doc_id] & sets[i]) >= 80 * len(sets[r.doc_id] | sets[i]) for i in sets if i < r.doc_id)
    e = c.decontamination(spark, some, small).collect()
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in e} == {i for i in sets if not any(t in rows[i].text for t in bench)}
    last = c.tokens(spark, some.limit(3), small).collect()
    assert all(bpe.hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest() == r.decoded_sha256 for r in last)
    extra = docs.limit(5).withColumn("_text_hash", docs.doc_id).withColumn("n_removed", docs.doc_id)
    assert c.line_dedup(spark, extra, small).columns == extra.columns and c.near_dedup(spark, extra.drop("_text_hash"), small).columns == extra.drop("_text_hash").columns
