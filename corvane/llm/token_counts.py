"""Token counts under a unigram model, by dynamic programming along a trie of words."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks

#: Words whose counts are remembered in a worker; then all are forgotten.
REMEMBERED = 600_000


def zipf_scores(path: str) -> dict[bytes, float]:
    """Log-scores of a public vocabulary's pieces: a piece of rank r counts as -ln(r + 1)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 1) for a, b in map(bytes.split, f)}


class TrieCounter:
    """Tokens of the best segmentation of each word, shared prefixes computed once.

    Distinct words in byte order are the depth-first walk of their trie.  The walk keeps the best score and its number
    of tokens for each node on the path from the root; the next word goes back to where it leaves the path
    and computes only the nodes below.  Terminal counts are kept by word.  A segmentation's score is the sum of its
    pieces' scores; of equal scores the one with fewer tokens counts.
    """

    def __init__(self, scores: dict[bytes, float], limit: int = REMEMBERED):
        self.scores, self.limit = scores, limit
        self.known: dict[bytes, int] = {}
        self.longest = max(map(len, scores), default=0)
        self.nodes = 0

    def learn(self, words: Iterable[bytes]) -> None:
        """Count each word behind a space, as a pre-token."""
        score, longest, known = self.scores, self.longest, self.known
        best, count, last = [(0.0)], [0], b""
        none = -math.inf
        for word in sorted(words):
            token = b" " + word
            same, most = 0, min(len(token), len(last))
            while same < most and token[same] == last[same]:
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for d in range(same + 1, len(token) + 1):
                b, c = none, 0
                for a in range(max(0, d - longest), d):
                    s = score.get(token[a:d])
                    if s is not None:
                        s += best[a]
                        if s > b or s == b and count[a] + 1 < c:
                            b, c = s, count[a] + 1
                best.append(b)
                count.append(c)
            self.nodes += len(token) - same
            if best[-1] == none:
                raise ValueError("the vocabulary lacks a byte")
            last = token
            known[word] = count[-1]

    def count(self, texts: list[list[bytes]]) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        new: set[bytes] = set().union(*texts)
        new.difference_update(self.known)
        self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, t)) for t in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> TrieCounter:
    return TrieCounter(zipf_scores(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = counter(path)
        for batch in batches:
            n_words, n_tokens = [], []
            for _, part in blocks([x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()], 4 << 20):
                words = [t.split() for t in part]
                n_words += map(len, words)
                n_tokens += trie.count(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for each row of ``docs(doc_id, text)``; no shuffle.

    Pre-tokens are words (runs without ASCII white space), each behind one space; ``vocabulary`` is a file of
    base64 pieces and ranks that holds every single byte, see :func:`zipf_scores`.  A task
    inserts the distinct words of some megabytes of text at a time and remembers a bounded number of counts.
    Null and empty texts: 0 and 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long")
