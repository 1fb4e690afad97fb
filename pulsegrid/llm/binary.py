"""Token ids as Arrow stream files of fixed-size lists.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its range and writes one shard: an Arrow stream
file whose batches hold `ids` and `mask`, both fixed-size lists of one length, so that sequence i of a memory-mapped file
lies at a fixed place of its batch and is read without a copy. Documents are packed one after the other, each with its end
id; the last sequence of a shard is filled up and masked. A second stream file holds the documents of the shard: doc_id,
start in the shard, and number of ids. Names and contents depend only on the shard, and a file is moved to its name when it
is whole, so a task that runs twice leaves the same files.

Words are encoded by the tokenizers library. Its normaliser and its word pattern never look across ASCII white space, so
each distinct word is encoded once (the words met before the last but one emptying of the cache are forgotten, so its size is
bounded) and texts are joined from words. A tokenizer of which this is not known encodes whole texts.

Defined cases: a null or empty text is its end id alone; rows that repeat a doc_id stand together in the order in which they are read; a
null doc_id comes first; strings of special tokens in a text are ordinary text; an empty table writes no files and gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, shared_dir, ship

LENGTH, BATCH, CACHE, TOGETHER = 2048, 64, 800_000, 1024
#: Letters that the word pattern takes and the normaliser leaves or folds one by one; closing punctuation.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
CLOSING = ".,;:!?"
SHARDS = "shard bigint, path string, n_docs bigint, n_ids bigint"
DOCS = "shard bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def id_type(size: int) -> np.dtype:
    """Two bytes an id where the vocabulary fits, else four."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    """Masks are bits, as Arrow keeps booleans."""
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class WordEncoder:
    """Ids of whole texts through a cache of words. What can be cut further without a change is: closing ASCII
    punctuation after a Latin letter is a match of the word pattern on its own, and ASCII case is folded by the normaliser;
    so most new words are plain Latin ones, which are encoded many at once and told apart by their end-of-word ids. This holds
    for lower-casing vocabularies with word ends (by_words)."""

    def __init__(self, spec: str, end_id: int, by_words: bool):
        from tokenizers import Tokenizer

        self.by_words, self.older = by_words, {}
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.kind = id_type(len(vocab))
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.end = np.array(end_id, self.kind).tobytes()

    def _alone(self, words: list[str]) -> None:
        for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cores[w] = np.array(e.ids, self.kind).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        joined = b"\n".join(new)
        low = joined.lower().decode().split("\n")  # ASCII alone is folded; no word holds white space
        bare = [t.rstrip(CLOSING) for t in low]
        plain = [x.isalpha() and (x.isascii() or PLAIN.fullmatch(x) is not None) for x in bare]
        # the normaliser composes marks before it folds, and some capitals compose only once folded: other words stay as they are
        texts = [t if p or t.isascii() else r for t, r, p in zip(low, joined.decode().split("\n"), plain, strict=True)]
        cores = self.cores
        some = list({x for x, p in zip(bare, plain, strict=True) if p} - cores.keys())
        groups = [some[k : k + TOGETHER] for k in range(0, len(some), TOGETHER)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            last = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(last) == len(group):
                raw = ids.tobytes()
                cores.update(zip(group, [raw[i:j] for i, j in zip([0, *last], last, strict=False)], strict=True))
            else:
                self._alone(group)
        odd = {t for t, p in zip(texts, plain, strict=True) if not p}
        odd.update(t[len(x) :] for t, x, p in zip(texts, bare, plain, strict=True) if p and len(t) > len(x))
        self._alone(list(odd - cores.keys()))
        whole = [cores[t] if not p or len(t) == len(x) else cores[x] + cores[t[len(x) :]] for t, x, p in zip(texts, bare, plain, strict=True)]
        self.words.update(zip(new, whole, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, self.kind).tobytes() + self.end for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.words) > CACHE:
            self.older, self.words, self.cores = self.words, {}, {}
        cuts = [(t or "").encode().split() for t in texts]
        known, older = self.words, self.older
        new = set().union(*cuts) - known.keys()
        met = new & older.keys()
        known.update(zip(met, map(older.__getitem__, met), strict=True))
        self._learn(list(new - met))
        return [b"".join(map(known.__getitem__, c)) + self.end for c in cuts]


#: The encoder of this Python worker: the tasks that it runs one after the other share tokenizer and words.
_HELD: dict[tuple[int, int, bool], WordEncoder] = {}


def held_encoder(spec: str, end_id: int, by_words: bool) -> WordEncoder:
    key = (zlib.crc32(spec.encode()), end_id, by_words)
    if key not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _HELD.clear()
        _HELD[key] = WordEncoder(spec, end_id, by_words)
    return _HELD[key]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(fs: pafs.FileSystem, path: str, schema: pa.Schema):
    """A stream writer to a name of this attempt, and what moves the whole file to its own name."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    sink = fs.open_output_stream(part)
    writer = pa.ipc.new_stream(sink, schema)

    def done() -> None:
        writer.close()
        sink.close()
        fs.move(part, path)

    return writer, done


def _write(spec, end_id: int, uri: str, length: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc, fs = held_encoder(spec.value, end_id, by_words), None
        kind, width = enc.kind, enc.kind.itemsize
        schema = sequence_schema(length, kind)
        left, n_ids, n_docs = b"", 0, 0
        unit = width * length

        def rows(data: bytes, valid: int) -> pa.RecordBatch:
            flat = np.frombuffer(data, kind)
            mask = np.arange(len(flat)) < valid
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                if fs is None:
                    fs, top = _open(uri)
                    out, close_out = _put(fs, f"{top}/shard-{shard:06d}.arrow", schema)
                    index, close_index = _put(fs, f"{top}/shard-{shard:06d}.docs", INDEX)
                got = enc.encode(part.column(1).to_pylist())
                sizes = np.array([len(x) // width for x in got], np.int64)
                starts = n_ids + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts), pa.array(sizes)], schema=INDEX))
                n_ids, n_docs = n_ids + int(sizes.sum()), n_docs + len(got)
                data = left + b"".join(got)
                for at in range(0, len(data) // unit // BATCH * BATCH * unit, BATCH * unit):
                    out.write_batch(rows(data[at : at + BATCH * unit], BATCH * length))
                left = data[len(data) // unit // BATCH * BATCH * unit :]
        if fs is not None:
            if left:
                full = -(-len(left) // unit) * unit
                out.write_batch(rows(left.ljust(full, b"\0"), len(left) // width))
            close_out()
            close_index()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{uri}/shard-{shard:06d}"], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int = 2, uri: str | None = None, length: int = LENGTH, shards: int | None = None, by_words: bool = False) -> DataFrame:
    """Write the shards and return one row a shard: shard, path (without .arrow and .docs), n_docs, n_ids. by_words: the
    tokenizer lower-cases, drops white space and has word ends, so that words can be encoded apart."""
    spark = docs.sparkSession
    ship(spark)
    uri = uri or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, top = _open(uri)
    fs.create_dir(top)
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus
    d = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # rows that share a doc_id can be dealt out too
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = d.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return cut(d.mapInArrow(_write(spec, end_id, uri, length, by_words), SHARDS), "shards")


def read_sequences(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of one shard; of a local file without a copy."""
    fs, top = _open(path + ".arrow")
    source = pa.memory_map(top) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(top)
    with source, pa.ipc.open_stream(source) as r:
        yield from r


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            stream, held = read_sequences(path), np.empty(0, np.uint16)
            fs, top = _open(path + ".docs")
            with fs.open_input_file(top) as source, pa.ipc.open_stream(source) as index:
                for docs in index:
                    crcs = []
                    for n in docs.column(2).to_pylist():
                        crc = 0
                        while n:
                            if not len(held):
                                rows = next(stream)
                                valid = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                                held = np.asarray(rows.column(0).flatten())
                                held = held if valid.all() else held[valid]
                            take = held[:n]
                            crc, n, held = zlib.crc32(take.astype("<u4"), crc), n - len(take), held[len(take) :]
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int64()), docs.column(0), docs.column(1), docs.column(2), pa.array(crcs, pa.int64())], schema=schema)


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. start counts the ids of all shards before."""
    spark = shards.sparkSession
    ship(spark)
    from pyspark.sql import Window

    offsets = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("offset"))  # one row a shard
    n = spark.sparkContext.defaultParallelism
    rows = shards.select("shard", "path").repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").mapInArrow(_read, DOCS)
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), by_words=True))
