"""Fill-in-the-middle transformation with cuts at unit ends.

A text is a sequence of units (white space with the word behind it; white space at the end is a unit of its own). Every
UTF-8 byte gets a class of three bits: whether it belongs to a word, whether it ends a unit, and whether it begins a code
point. A wavelet matrix over the classes of a slice of texts answers rank queries: the ranks of the classes that end a unit
add up to the number of units before a place, those of the classes that begin a code point to the number of characters. Both
cuts of all texts of a slice are found together by bisection on these counts, so a text is never cut into tokens.

The rewritten text is prefix, suffix and middle behind marks, or suffix first; a text that holds a mark itself, an empty one,
and the share that the seed leaves out stay plain. restored() rebuilds the text from output and form.

Defined cases: a null text is empty and stays plain; a null doc_id hashes like an empty id; rows that repeat are each
rewritten, alike; any length of text is one row and is never split; an empty table gives an empty result; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import WHITE, ship, text_bytes

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
WORD, END, LEAD = 4, 2, 1
ROWS, BYTES = 512, 1 << 22
OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE.encode())] = False


class WaveletMatrix:
    """Symbols of a few bits, one bit vector a level from the highest bit on; each level is sorted stably by its bit. A bit
    vector keeps its words of 64 bits and the count of ones before each."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            b = np.packbits(bit, bitorder="little")
            packed[: len(b)] = b
            words = packed.view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        w, low = at >> 6, (at & 63).astype(np.uint64)
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << low) - np.uint64(1)))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are this one, for each place."""
        lo, hi = np.zeros(1, np.int64), at
        for k, (words, before, zeros) in enumerate(self.levels):
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, mask: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols have the bit of mask: the ranks of those symbols together."""
        return sum(self.rank(s, at) for s in range(1 << self.bits) if s & mask)

    def locate(self, mask: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least place in lo .. hi with so many symbols of the mask before it, for each wanted count."""
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.count(mask, mid) < want
            lo, hi = np.where(less & (lo < hi), mid + 1, lo), np.where(less, hi, mid)
        return lo


def classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each byte of the texts that begin at `at`."""
    word = _IS_WORD[data]
    last = np.zeros(len(data), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    end = last.copy()
    end[:-1] |= word[:-1] & ~word[1:]
    return word * np.uint8(WORD) + end * np.uint8(END) + ((data & 0xC0) != 0x80) * np.uint8(LEAD)


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and about BYTES bytes, a row at least."""
    at, k = text_bytes(b.column(1))[1], 0
    while k < b.num_rows:
        n = int(np.searchsorted(at, at[k] + BYTES, "right")) - 1 - k
        n = max(1, min(n, ROWS, b.num_rows - k))
        yield b.slice(k, n)
        k += n


def _rewrite(marks: tuple[str, str, str], rate: int, spm: int):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _pieces(batch):
                data, at = text_bytes(b.column(1))
                h = [b.column(k).to_numpy() for k in range(2, 6)]
                matrix = WaveletMatrix(classes(data, at), 3)
                begin, stop = at[:-1], at[1:]
                ends, chars = matrix.count(END, at), matrix.count(LEAD, begin)
                n = np.diff(ends)
                cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
                cuts = np.array([matrix.locate(END, ends[:-1] + c, begin, stop) for c in cuts])
                sizes = np.array([matrix.count(LEAD, c) for c in cuts]) - chars
                raw = data.tobytes()
                forms, outs = [], []
                for a, i, j, z, h3, h4 in zip(begin.tolist(), *cuts.tolist(), stop.tolist(), h[2].tolist(), h[3].tolist(), strict=True):
                    text = raw[a:z]
                    if not text or h3 % 100 >= rate or p in text or s in text or m in text:
                        forms.append("plain")
                        outs.append(text)
                    elif h4 % 100 < spm:
                        forms.append("spm")
                        outs.append(b"".join((s, raw[j:z], p, raw[a:i], m, raw[i:j])))
                    else:
                        forms.append("psm")
                        outs.append(b"".join((p, raw[a:i], s, raw[j:z], m, raw[i:j])))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n), pa.array(forms), pa.array(sizes[0], mask=plain), pa.array(sizes[1] - sizes[0], mask=plain), pa.array(outs, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output. rate: of 100 texts so many are rewritten, spm:
    of 100 of those so many with the suffix first. The choices hang on the seed and the id alone."""
    ship(docs.sparkSession)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *parts)
    return d.mapInArrow(_rewrite(marks, rate, spm), OUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was rewritten. No mark stands in such a text, and none can arise where parts meet, since no end of a mark is
    the begin of one."""
    p, s, m = (rf"\Q{x}\E" for x in marks)
    part = lambda first, other, k: F.get(F.split(F.substring(output, len(first) + 1, (1 << 31) - 1), f"{other}|{m}", -1), F.lit(k))
    psm = F.concat(part(marks[0], s, 0), part(marks[0], s, 2), part(marks[0], s, 1))
    spm = F.concat(part(marks[1], p, 1), part(marks[1], p, 2), part(marks[1], p, 0))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fim_query(spark, sf_dir: str) -> DataFrame:
    d = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
