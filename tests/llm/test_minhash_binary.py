import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pulsegrid.llm import binary, minhash

JSON = public_tokenizers.path("word_bpe_49k.json")


def brute_components(rows, width=2):
    sets = [set(map(int, x)) for x in minhash.shingle_sets(pa.array([t for _, t in rows], pa.string()), width)]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d if d is not None else -1), len(sets[i]), (min(g) if None not in (g := groups[find(i)]) else -1)) for i, (d, _) in enumerate(rows))


def test_near_duplicates_meet_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (2, ""), (3, "one"), (4, "ONE"), (None, "one"), (5, "a b"), (6, "A  b\n"), (7, "x " * 30_000), (8, "x x")]
    for k in range(12):  # a chain: neighbours are similar, ends are not
        rows.append((100 + k, " ".join(base[2 * k : 2 * k + 40])))
    rows += [(200, " ".join(base)), (200, " ".join(base)), (150, " ".join(base) + " tail"), (300, "É b c"), (301, "é b c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, kept int, bands int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, (r.component_id if r.component_id is not None else -1)) for r in minhash.near_duplicates(df, width=2).collect())
    assert got == brute_components(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_star_rounds_find_links_beside_the_centre(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):  # groups of unlike texts that still share buckets with few rows a band
        words = [f"g{g}_{i}" for i in range(50)]
        for k in range(8):
            w = words.copy()
            for i in rng.integers(0, 50, 3 * (k % 4)):
                w[i] = f"z{rng.integers(1000)}"
            rows.append((g * 100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=2, bands=64, rows=1).collect())
    assert got == brute_components(rows)


def _pair(rng, n, share):
    """Two sorted sets of hashes with this Jaccard similarity (about n elements each)."""
    both = round(2 * n * share / (1 + share))
    x = np.unique(rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64))
    return np.sort(np.concatenate([x[:both], x[both:n]])), np.sort(np.concatenate([x[:both], x[n:]]))


def _mixed(s):
    return np.unique(minhash.mix(s))


def test_densified_bins_agree_as_jaccard():
    rng, one = np.random.default_rng(0), minhash.OnePermutation(32, 5)
    for n in (8, 40, 400):
        agree = []
        for _ in range(300):
            a, b = (rng.permutation(x) for x in _pair(rng, n, 0.8))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((one.signature(np.sort(a)) == one.signature(np.sort(b))).mean() - j)
        assert abs(np.mean(agree)) < 0.02


def test_recall_of_bands_and_sketches_at_the_similarity():
    """Of 2,000 pairs at 0.80 to 0.85, short and long, all share a bucket and pass the sketches; unlike ones rarely do."""
    rng, one, lost = np.random.default_rng(1), minhash.OnePermutation(32, 5), 0
    for n in (10, 30, 150, 400):
        for k in range(500):
            a, b = _pair(rng, n, 0.8 + 0.05 * k / 500)
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            x, y = one.signature(a), one.signature(b)
            unlike = sum(((p ^ q) & 0xFFFFFFFFFFFFFFFF).bit_count() for p, q in zip(one.sketch(a, x), one.sketch(b, y), strict=True))
            near = 180 * unlike <= 20 * (len(a) + len(b)) if max(len(a), len(b)) < minhash.SMALL else unlike <= minhash.LIMIT
            lost += not (near and (one.band_keys(x) == one.band_keys(y)).any())
    assert lost <= 2


def test_token_files_round_trip(spark, small, tmp_path):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [(-5, None), (-4, ""), (-3, "É İ ſ Σς <|endoftext|> it's 123\x00\x1c x"), (-2, "word " * 9000), (-6, "It's, don't! J\u030c A\u0300 \u212b x... (yes). ʼN ŉ İx ÉÈ! naïve; 3.5, a,b ß? ÷ ×x Ω… ǅ end:"), (-1, "same"), (-1, "same"), *real]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, shard int").repartition(7)
    shards = binary.write_tokens(df, JSON, uri=f"file://{tmp_path}/t", length=64, shards=5, by_words=True)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in binary.read_tokens(shards).collect())
    want, at, all_ids = [], 0, []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        all_ids += ids
    assert got == want
    seen = []
    for s in sorted(shards.collect(), key=lambda r: r.shard):
        for b in binary.read_sequences(s.path):
            assert b.schema.field("ids").type.list_size == 64
            seen += b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)].tolist()
    assert seen == all_ids
    assert binary.read_tokens(binary.write_tokens(df.limit(0), JSON, uri=f"file://{tmp_path}/e")).count() == 0
