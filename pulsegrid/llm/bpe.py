"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one in-memory database a task.

Spark deals out the documents; inside a task the distinct words of a slice of texts become token-position rows, and a
recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of least rank until
no pair is left. Decoding joins ids with the vocabulary and aggregates the pieces in order.

A text is matched by the tokenizer's pattern. Between a character that is not white space and a space that a character
other than white space follows, a match always ends; so where a text has no run of white space it is cut there first, and
each distinct piece is matched, encoded and decoded once. The caches are emptied at a fixed size.

A word of LONG bytes or more is first cut where no token of the vocabulary can cross, which leaves its ids as they are. A part
that is still as long would leave too many rows of old states in a recursive query, so a step query that keeps only the
newest rows contracts it: all places of its least pair up to the first that gives rise to a pair of lower rank.

Defined cases: a null or empty text has no tokens; words of any length are encoded whole; ids outside the vocabulary raise an
error; repeated rows return as often as they stand; an empty table gives an empty result; columns other than doc_id and
text (ids) are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import kept, map_rows, ship

#: Pieces kept by a worker; the words kept and the rows worked on at once are in proportion.
CACHE, LONG, LONG_BYTES = 300_000, 100, 400_000

#: start(w, p, t, n): word, place, token and the token after it. The last state of each word comes back as its ids in decimals
#: and as the bytes that the vocabulary decodes them to.
ENCODE = """
WITH RECURSIVE s(w, p, t, n, r, it) AS (
  SELECT a.w, a.p, a.t, a.n, m.tok, 0 FROM start a LEFT JOIN merges m ON m.pair = a.t::BIGINT * 65536 + a.n
  UNION ALL
  SELECT q.w, q.p, q.t, q.n, coalesce(m.tok, q.r), q.it
  FROM (
    SELECT s.w, (s.p - (s.p > b.p)::INT)::INT AS p, CASE WHEN s.p = b.p THEN b.m ELSE s.t END AS t,
      CASE WHEN s.p = b.p THEN b.n WHEN s.p = b.p - 1 THEN b.m ELSE s.n END AS n,
      CASE WHEN s.p <> b.p AND s.p <> b.p - 1 THEN s.r END AS r,
      CASE WHEN s.p = b.p THEN b.m::BIGINT * 65536 + b.n WHEN s.p = b.p - 1 THEN s.t::BIGINT * 65536 + b.m END AS pair, s.it + 1 AS it
    FROM s JOIN (
      SELECT c.w, d.p, d.m, c.n
      FROM s c JOIN (SELECT w, (best & 1048575)::INT AS p, (best >> 20)::INT AS m
                     FROM (SELECT w, min((r::BIGINT << 20) | p) AS best FROM s WHERE r IS NOT NULL GROUP BY w)) d ON c.w = d.w AND c.p = d.p + 1
    ) b ON s.w = b.w
    WHERE s.p <> b.p + 1
  ) q LEFT JOIN merges m ON m.pair = q.pair
)
SELECT w, string_agg(v.said, ' ' ORDER BY p) AS said, string_agg(v.piece, '' ORDER BY p) AS piece, count(*) AS n
FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) USING (w, it) JOIN vocab v ON v.id = s.t GROUP BY w ORDER BY w
"""
#: One step for a long part of a word: the places of its least pair from the left, up to the first whose new token makes a
#: pair of lower rank with a neighbour, which then has to come before the others.
STEP = """
CREATE OR REPLACE TABLE state AS
WITH a AS (SELECT w, p, t, lag(t) OVER o AS prev, lead(t) OVER o AS n, lead(t, 2) OVER o AS nn FROM state WINDOW o AS (PARTITION BY w ORDER BY p)),
b AS (SELECT a.*, m.tok AS r FROM a LEFT JOIN merges m ON m.pair = a.t::BIGINT * 65536 + a.n),
c AS (SELECT *, min(r) OVER (PARTITION BY w) AS least FROM b),
d AS (SELECT *, coalesce(r = least, false) AS hit, p - row_number() OVER (PARTITION BY w, coalesce(r = least, false) ORDER BY p) AS run FROM c),
e AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY p) % 2 = 1 AS could FROM d),
f AS (SELECT *, CASE WHEN could THEN CASE WHEN coalesce(lag(could, 2) OVER (PARTITION BY w ORDER BY p), false) THEN least ELSE prev END END AS before FROM e),
g AS (SELECT f.*, could AND (coalesce(x.tok < least, false) OR coalesce(y.tok < least, false)) AS first_more
      FROM f LEFT JOIN merges x ON f.could AND x.pair = f.before::BIGINT * 65536 + f.least LEFT JOIN merges y ON f.could AND y.pair = f.least::BIGINT * 65536 + f.nn),
h AS (SELECT *, could AND coalesce(sum(first_more::INT) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS take FROM g),
i AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY p), false) AS gone, sum(take::INT) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS less FROM h)
SELECT w, (p - coalesce(less, 0))::INT AS p, CASE WHEN take THEN least ELSE t END AS t FROM i WHERE NOT gone
"""
STATE = "SELECT w, string_agg(v.said, ' ' ORDER BY p) AS said, string_agg(v.piece, '' ORDER BY p) AS piece, count(*) AS n FROM state s JOIN vocab v ON v.id = s.t GROUP BY w ORDER BY w"
DECODE = "SELECT d, string_agg(piece, '' ORDER BY p) AS text, count(*) AS n FROM chosen JOIN vocab USING (id) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """The database of one worker: merge table, vocabulary, and the words met of late (their ids in decimals, decoded bytes)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), cache
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(a * 65536 + b, v) for k, v in ranks.items() for i in range(1, len(k)) if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "tok": pa.array([t for _, t in pairs], pa.int32())})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [k.decode("latin-1") for k in ranks], "said": list(map(str, ranks.values()))})
        for name, t in (("merges", merges), ("vocab", vocab)):
            self.con.register("given", t)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.bytes_ = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.words: dict[str, tuple[str, bytes]] = {}
        self.crossed: tuple[np.ndarray, np.ndarray] | None = None

    def _start(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(n)
        t = self.bytes_[flat]
        follow = np.zeros(len(t), bool)
        follow[end - 1] = True
        after = pa.array(np.append(t[1:], 0), mask=follow)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "p": (np.arange(len(flat)) - np.repeat(end - n, n)).astype(np.int32), "t": t, "n": after})

    def _merged(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """Ids and decoded bytes of words, all short or all long."""
        self.con.register("start", self._start(words))
        if len(words[0]) < LONG:
            got = self.con.sql(ENCODE).to_arrow_table()
        else:
            self.con.execute("CREATE OR REPLACE TABLE state AS SELECT w, p, t FROM start")
            left, now = None, sum(map(len, words))
            while left != now:
                self.con.execute(STEP)
                left, now = now, self.con.execute("SELECT count(*) FROM state").fetchall()[0][0]
            got = self.con.sql(STATE).to_arrow_table()
        self.con.unregister("start")
        return list(zip(got.column("said").to_pylist(), [x.encode("latin-1") for x in got.column("piece").to_pylist()], strict=True))

    def parts(self, word: bytes) -> list[bytes]:
        """The word cut where no token can cross: no token is those two bytes, nor holds them with a neighbour."""
        if self.crossed is None:
            two, three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
            for k in self.ranks:
                if len(k) == 2:
                    two[k[0] << 8 | k[1]] = True
                for i in range(len(k) - 2):
                    three[k[i] << 16 | k[i + 1] << 8 | k[i + 2]] = True
            self.crossed = two, three
        two, three = self.crossed
        x = np.frombuffer(word, np.uint8).astype(np.int64)
        pair = two[x[:-1] << 8 | x[1:]]
        triple = three[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        pair[:-1] |= triple
        pair[1:] |= triple
        cut = np.flatnonzero(~pair) + 1
        return [word[i:j] for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(word)], strict=True)]

    def _encoded(self, words: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        out: dict[bytes, tuple[str, bytes]] = {}
        groups, room = [], 0
        for w in sorted(words, key=len):
            cost = len(w) if len(w) >= LONG else len(w) ** 2  # rows of one state, or of all states of a recursive query
            if not groups or cost > room or (len(groups[-1][0]) < LONG) != (len(w) < LONG):
                groups.append([])
                room = LONG_BYTES if len(w) >= LONG else 20 * self.cache
            groups[-1].append(w)
            room -= cost
        for g in groups:
            out.update(zip(g, self._merged(g), strict=True))
        return out

    def learn(self, words: set[str]) -> None:
        """Encode and decode words that were not met yet."""
        short, long = {}, {}
        for w in words:
            if w not in self.words:
                b = w.encode()
                if (one := self.ranks.get(b)) is not None:
                    self.words[w] = (str(one), b)
                elif len(b) < LONG:
                    short[w] = b
                else:
                    long[w] = self.parts(b)
        known = self._encoded(list(set(short.values()).union(*long.values())))
        for w, b in short.items():
            self.words[w] = known[b]
        for w, some in long.items():
            self.words[w] = (" ".join([known[x][0] for x in some]), b"".join([known[x][1] for x in some]))

    def decode(self, raw: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids (given as int32)."""
        n = np.array([len(x) // 4 for x in raw], np.int64)
        ids = np.frombuffer(b"".join(raw), np.int32)
        self.con.register("chosen", pa.table({"d": np.repeat(np.arange(len(n)), n), "p": np.arange(len(ids)), "id": ids}))
        got = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("chosen")
        d = got.column("d").to_numpy()
        if not np.array_equal(got.column("n").to_numpy(), n[d]) or len(d) != np.count_nonzero(n):
            raise ValueError("an id is outside the vocabulary")
        out = [b""] * len(raw)
        for k, text in zip(d.tolist(), got.column("text").to_pylist(), strict=True):
            out[k] = text.encode("latin-1")
        return out


#: White space next to white space, or at an end: such a text is matched whole.
RUNS = re.compile(r"\s\s|\A\s|\s\Z")


class Pieces:
    """Encodes and decodes texts through their distinct pieces. What was not met since the last but one emptying of the cache is
    forgotten, so its size is bounded."""

    def __init__(self, bpe: Bpe, at_spaces: bool):
        self.at_spaces = at_spaces
        self.bpe, self.said, self.back, self.older = bpe, {}, {}, ({}, {})

    def cut(self, text: str) -> list[str]:
        if not self.at_spaces or RUNS.search(text):
            return self.bpe.pattern.findall(text)
        head, *rest = text.split(" ") if text else ("",)
        return [head, *[" " + x for x in rest]] if head else []

    def take(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards said and back know them all."""
        bpe = self.bpe
        if len(self.said) > bpe.cache:
            self.older, self.said, self.back = (self.said, self.back), {}, {}
        if len(bpe.words) > bpe.cache * 4 // 3:
            bpe.words = {}
        cuts = [self.cut(t) for t in texts]
        new = set().union(*cuts) - self.said.keys()
        said, back = self.older
        for x in new & said.keys():
            self.said[x], self.back[x] = said[x], back[x]
        new = list(new - said.keys())
        found = [bpe.pattern.findall(x) for x in new]
        bpe.learn(set().union(*found))
        words = bpe.words
        pairs = [words[f[0]] if len(f) == 1 else (" ".join([words[w][0] for w in f]), b"".join([words[w][1] for w in f])) for f in found]
        self.said.update(zip(new, [p[0] for p in pairs], strict=True))
        self.back.update(zip(new, [p[1] for p in pairs], strict=True))
        return cuts


def held_pieces(ranks: dict[bytes, int], pattern: str, at_spaces: bool, cache: int = CACHE) -> Pieces:
    """The encoder of this Python worker: the tasks of a stage that it runs one after the other share database and words."""
    key = (len(ranks), hash(tuple(ranks.items())), pattern, at_spaces, cache)
    return kept(key, lambda: Pieces(Bpe(ranks, pattern, cache), at_spaces))


def _round_trip(ranks, pattern: str, with_ids: bool, at_spaces: bool, cache: int) -> Callable:
    def make():
        pieces = held_pieces(ranks.value, pattern, at_spaces, cache)

        def fn(c: dict) -> dict:
            cuts = pieces.take([t or "" for t in c["text"]])
            said, back = pieces.said.__getitem__, pieces.back.__getitem__
            joined = [" ".join(map(said, p)) for p in cuts]
            n = [s.count(" ") + 1 if s else 0 for s in joined]
            out = {
                "doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in joined],
                "decoded_sha256": [hashlib.sha256(b"".join(map(back, p))).hexdigest() for p in cuts],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.fromstring(" ".join(joined), np.int32, sep=" ")))
            return out

        return fn

    return make


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, at_spaces: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array<int>) of each document. at_spaces: a match of the
    pattern always ends before a space between two characters that are not white space (so with public_tokenizers.PATTERN). cache:
    pieces that a worker keeps; fewer take less memory and more time."""
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: under 2 MB, whatever the corpus
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs.select("doc_id", "text"), _round_trip(ranks, pattern, with_ids, at_spaces, cache), schema, rows=max(128, 2048 * cache // CACHE))


def _decode(ranks, pattern: str) -> Callable:
    def make():
        bpe = Bpe(ranks.value, pattern)
        return lambda c: {"doc_id": c["doc_id"], "decoded": bpe.decode([np.array(x or [], np.int32).tobytes() for x in c["ids"]])}

    return make


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, decoded (bytes) of each row of (doc_id, ids)."""
    ship(tokens.sparkSession)
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return map_rows(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), _decode(ranks, r"\S+"), "doc_id bigint, decoded binary")


def bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, at_spaces=True)
