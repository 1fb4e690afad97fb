import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", "\n\t ", "a", " a", "a ", "a b", "é ü x  z\x0b", "<P> in a text", "x <M", "<S", "S> <P", "\U0001f600 \U0001f600\U0001f600 end\n", "naïve \x00 nul\x1c sep", "w " * 5000, "long" * 70_000, "a<b c<S d>M> e<P f<", "\r\n".join("line %d of text" % i for i in range(300))]


def plain_python(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_wavelet_matrix_counts_and_places():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        s = rng.integers(0, 8, n).astype(np.uint8)
        m = fim.WaveletMatrix(s, 3)
        at = np.arange(n + 1)
        for c in range(8):
            assert (m.rank(c, at) == np.concatenate([[0], np.cumsum(s == c)])).all()
        for mask in (1, 2, 4):
            run = np.concatenate([[0], np.cumsum((s & mask) > 0)])
            want = np.arange(run[-1] + 1)
            got = m.locate(mask, want, np.zeros(len(want), np.int64), np.full(len(want), n))
            assert (got == np.searchsorted(run, want)).all()


def test_texts_of_all_kinds(spark, monkeypatch):
    rows = [(i, t, 7, "x") for k in range(40) for i, t in enumerate(TEXTS, 100 * k)] + [(None, "a b c d", 7, "x"), (5, "twice here", 1, "y"), (5, "twice here", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string").repartition(3)
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i is not None, i or 0), *plain_python(i, t), t or "") for i, t, *_ in rows)
    key = lambda x: tuple((v is not None, v) for v in x[1:])
    have = sorted((((r.doc_id is not None, r.doc_id or 0), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=lambda x: (x[0], key(x)))
    assert have == sorted(want, key=lambda x: (x[0], key(x)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_other_marks_and_rates(spark):
    df = spark.createDataFrame([(i, f"some words {i} here") for i in range(60)], "doc_id bigint, text string")
    marks = ("[pre|", "(suf*", "{mid+")
    got = fim.fill_in_middle(df, seed=7, rate=100, spm=50, marks=marks)
    assert got.where("form = 'plain'").count() == 0
    back = got.join(df, "doc_id").where(fim.restored(F.col("output"), F.col("form"), marks) == F.col("text"))
    assert back.count() == 60


def test_query_meets_its_sql(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    want = sorted(duckdb.sql(fim.ORACLE).fetchall())
    got = fim.fim_query(spark, small)
    assert sorted(tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()) == want
