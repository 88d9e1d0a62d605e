"""Shared pieces of the corpus operators: scratch tables and numpy text blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.workers import CACHES, map_batches, release, slices, tidy
from corvane.sources.scratch import Scratch, shared_root, spread

#: Java/Spark pattern of the white space that separates words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- marks: a hash set of fixed size ------------------------------------------
#
# 2 ** MARK_BITS rows of 64 bits at most, whatever the number of hashes in it.  A hash that isn't marked
# is surely not in the set; one that is may be, and is verified by a join.  With ten million hashes one in seven
# others is marked, with a billion all are: then the join does the work, and results are the same.

MARK_BITS = 20


def _slot(h: str) -> str:
    return f"CAST(shiftrightunsigned({h}, {64 - MARK_BITS}) AS INT)"


def _bit(h: str) -> str:
    return f"shiftleft(1L, CAST(shiftrightunsigned({h}, {58 - MARK_BITS}) & 63 AS INT))"


def marks(hashes: DataFrame, h: str) -> DataFrame:
    """``(slot, bits)``: the marks of a column of 64-bit hashes."""
    return hashes.select(F.expr(_slot(h)).alias("slot"), F.expr(_bit(h)).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def marked(df: DataFrame, h: str, table: DataFrame, name: str = "__marked") -> DataFrame:
    """Add whether the hash ``h`` is marked in ``table`` (at most 2 ** MARK_BITS rows, so it is broadcast); a null hash isn't."""
    t = F.broadcast(table.select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits")))
    out = df.join(t, F.expr(_slot(h)) == F.col("__slot"), "left")
    return out.withColumn(name, F.coalesce(F.expr(f"__bits & {_bit(h)} <> 0"), F.lit(False))).drop("__slot", "__bits")


def without(docs: DataFrame, h: Column, gone: DataFrame, gone_h: str, same: Column, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows that meet one of ``gone`` under ``same``; ``h`` is a hash of a row, ``gone_h`` the same one in ``gone``.

    Only rows whose hash is marked go through the anti-join; the texts of all others stay where they are read.
    """
    table = scratch.table(marks(gone, gone_h), "gone-marks")
    rows = marked(docs.withColumn("__h", h), "__h", table)
    sure = rows.where("NOT __marked")
    rest = rows.where("__marked").join(gone, same, "left_anti")
    return sure.unionByName(rest).drop("__h", "__marked")


# --- numpy text blocks -------------------------------------------------------
#
# A block is a list of documents whose words are joined by one space, and the
# documents by one newline, so word bounds are the single bytes 32 and 10.
# Words are hashed by a polynomial over the ring of 64-bit integers; the base is
# odd, hence invertible, so that any span's hash follows from two prefix sums.

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = []
CACHES.append(_pow)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection with good avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> list[np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pow[:] = out
    return _pow


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair of ascending bounds; equal spans get equal hashes.

    Bytes (uint8) are first replaced by fixed random 64-bit numbers.  The work goes by
    in strips of ``step`` values, so its memory doesn't grow with the block.
    """
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + step, side="right")))
        v = values[base : int(end[hi - 1])]
        v = _BYTE[v] if v.dtype == np.uint8 else v
        power, inverse = _powers(len(v) + 1)
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * power[: len(v)], out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s])
        lo = hi
    return out


class Block:
    """Words of some documents: bytes, bounds, and the range of words of each document."""

    def __init__(self, docs: list[bytes]):
        self.n_docs = len(docs)
        self.text = b"\n".join(docs) + b"\n"
        self.buf = np.frombuffer(self.text, np.uint8)
        cut = np.flatnonzero((self.buf == 32) | (self.buf == 10))
        line_end = self.buf[cut] == 10
        start = np.concatenate(([0], cut[:-1] + 1)) if len(cut) else cut
        word = cut > start  # an empty document leaves an empty "word"
        doc = np.concatenate(([0], np.cumsum(line_end)[:-1])) if len(cut) else cut
        self.start, self.end, self.doc = start[word], cut[word], doc[word]
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.n_words = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of k words inside one document."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.first[self.doc[at] + 1] - at >= k]
        return at, span_hashes(hashes, at, at + k)


def canonical(text: bytes | None) -> bytes:
    """Words (runs without ASCII white space) joined by one space; null has none."""
    return b" ".join(text.split()) if text else b""


def blocks(docs: Iterable[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of documents of about ``limit`` bytes: index of the first, documents."""
    at, held, size = 0, [], 0
    for i, d in enumerate(docs):
        held.append(d)
        size += len(d)
        if size >= limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def spans_equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether ``buf[a:a+length] == buf[b:b+length]`` byte by byte, for each row."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(length)
    lo = 0
    while lo < len(a):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + step, side="right")))
        n = length[lo:hi]
        off = np.concatenate(([0], np.cumsum(n)[:-1]))
        inner = np.arange(int(n.sum())) - np.repeat(off, n)
        same = buf[np.repeat(a[lo:hi], n) + inner] == buf[np.repeat(b[lo:hi], n) + inner]
        bad = np.repeat(np.arange(hi - lo), n)[~same]
        out[lo + bad] = False
        lo = hi
    return out
