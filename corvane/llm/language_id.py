"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, map_batches, mix, slices, tidy

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Characters of a text that are scored at a time.
STRIP = 1 << 19
#: Characters of short texts that are counted or scored together; their arrays take some 100 bytes a character.
BLOCK = 1 << 17
#: Numbers in a model, which is broadcast: 64 MB, or 256 labels of all buckets.
MAX_CELLS = 1 << 24


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def hashed_ngrams(texts: list[str], orders: Sequence[int] = ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of each character n-gram, and where each text's n-grams begin.

    Texts are lower-cased; n-grams are of code points and never cross a text's end.
    """
    texts = [t.lower() for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(code))  # characters of the text from here on
    for n in orders:
        key = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for j in range(n):
            key = key * np.uint64(1_114_127) + code[j : j + len(key)]
        inside = left[: len(key)] >= n
        yield (mix(key[inside]) >> np.uint64(32)).astype(np.int64) % buckets, np.concatenate(([0], np.cumsum(np.maximum(size - n + 1, 0))))


@dataclass(frozen=True)
class Model:
    """Log-probabilities (buckets, labels), log priors and the labels, in code-point order."""

    labels: list[str]
    table: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str], orders: Sequence[int] = ORDERS) -> np.ndarray:
        """Log joint probability of each text and label: sums of the table's rows, bucket by bucket.

        A text longer than ``STRIP`` goes in strips; each order's strips overlap by what one n-gram needs, so that each n-gram counts once.
        """
        long = [i for i, t in enumerate(texts) if len(t) > STRIP]
        if long and len(texts) > 1:
            total = self.scores([t if len(t) <= STRIP else "" for t in texts], orders)
            for i in long:
                total[i] = self.scores([texts[i]], orders)[0]
            return total
        total = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        if long:
            low = texts[0].lower()
            for n in orders:
                for at in range(0, len(low), STRIP):
                    for bucket, _ in hashed_ngrams([low[at : at + STRIP + n - 1]], (n,), len(self.table)):
                        total += self.table[bucket].sum(axis=0, dtype=np.float64)
            return total
        for bucket, cut in hashed_ngrams(texts, orders, len(self.table)):
            some = np.flatnonzero(np.diff(cut))
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], cut[some], axis=0, dtype=np.float64)
        return total

    def predict(self, texts: list[str | None], orders: Sequence[int] = ORDERS) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.labels and has_letter(t)]
        label, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if known:
            s = self.scores([texts[i] for i in known], orders)
            best = s.argmax(axis=1)
            p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, x in zip(known, best.tolist(), p.tolist(), strict=True):
                label[i], score[i] = self.labels[b], x
        return label, score


def held_out() -> Column:
    """Whether crc32 of the doc_id's text leaves 2 when divided by 4; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _count(buckets: int, orders: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            by: dict[str, list[str]] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(label, []).append(text)
            for label, texts in by.items():
                mine = counts.setdefault(label, np.zeros(buckets, np.int64))
                for _, part in blocks(texts, BLOCK):
                    for bucket, _ in hashed_ngrams(part, orders, buckets):
                        mine += np.bincount(bucket, minlength=buckets)
        for label, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(mine[at])], ["label", "bucket", "n"])

    return tidy(run)


def train(
    docs: DataFrame,
    label: str = "lang",
    max_train_docs: int = 20_000,
    buckets: int = BUCKETS,
    orders: Sequence[int] = ORDERS,
    alpha: float = 0.1,
) -> Model:
    """Fit on the rows of ``docs(doc_id, text, <label>)`` that :func:`held_out` leaves.

    ``max_train_docs`` bounds the sample: a label with more rows gives, by a hash of doc_id,
    that many in expectation; one with fewer gives all.  The model has ``MAX_CELLS`` numbers at most and is summed on the cluster: where
    labels times ``buckets`` would be more, buckets are halved until they fit.  Rows without a doc_id or a label are not learned from; a
    null text counts for its label's share alone.  Repeated rows count as often as they come; an empty table gives a model without labels.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    seen = rows.groupBy("label").agg(F.count("*").alias("n")).collect()  # one row a language
    while len(seen) * buckets > MAX_CELLS and buckets > 1:
        buckets //= 2
    labels = sorted(r["label"] for r in seen)
    n = {r["label"]: r["n"] for r in seen}
    table = np.zeros((buckets, len(labels)), np.float64)
    if labels:
        share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, max_train_docs / n[k]))])
        place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
        sample = rows.where("text IS NOT NULL").where(place < F.element_at(share, F.col("label"))).select("label", "text")
        sums = map_batches(sample, _count(buckets, orders), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
        by_label = sums.groupBy("label").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("c"))  # MAX_CELLS numbers at most
        for r in by_label.collect():
            table[r["b"], labels.index(r["label"])] = r["c"]
    total = table.sum(axis=0)
    table = np.log((table + alpha) / (total + alpha * buckets))
    prior = np.array([math.log(n[k] / sum(n.values())) for k in labels])
    return Model(labels, np.ascontiguousarray(table, np.float32), prior)


def _predict(model, orders: Sequence[int], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, whole.schema.get_field_index("text"))):
            at = batch.schema.get_field_index("text")
            label, score = [], []
            for _, part in blocks([t or "" for t in batch.column(at).to_pylist()], BLOCK):
                a, b = model.value.predict(part, orders)
                label += a
                score += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

    return tidy(run)


def predict(docs: DataFrame, model: Model, orders: Sequence[int] = ORDERS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (with a column text) and two columns called ``names``: the likeliest label and its posterior probability.

    The model is broadcast; a batch's n-grams look up its rows.  Null and empty texts, texts without a letter, and all texts
    where nothing could be learned, get ``und`` and 0; equally likely labels: the first in code-point order.  Columns of ``docs`` with
    one of the ``names`` are replaced, all others stay; rows come out as often as they went in.  Very long texts are taken
    ``STRIP`` characters at a time.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return map_batches(docs, _predict(shared, orders, names), ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double"]))
