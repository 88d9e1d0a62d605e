"""Exact removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Block, blocks, canonical, mix, shuffle_partitions, span_hashes, spans_equal

WINDOW = 13
GRAM = 2
LAST = 2**63 - 1  # stands for a null doc_id: after all others


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def smallest_owner(text: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window ``text[s:e]`` with hash ``h``, the smallest owner of an equal window.

    Sorting by hash brings equal windows together; neighbours are then compared byte
    by byte.  A run whose hashes agree but whose bytes differ is grouped by its bytes.
    """
    order = np.lexsort((owner, h))
    hs = h[order]
    same = np.concatenate(([False], hs[1:] == hs[:-1])) if len(hs) else np.zeros(0, bool)
    second = np.flatnonzero(same)
    low = owner.copy()
    if not len(second):
        return low
    a, b = order[second - 1], order[second]
    equal = (e[a] - s[a]) == (e[b] - s[b])
    equal[equal] = spans_equal(np.frombuffer(text, np.uint8), s[a[equal]], s[b[equal]], (e - s)[a[equal]])
    run = np.cumsum(~same)  # number of the run of each sorted place
    head = np.flatnonzero(~same)
    low[order] = owner[order[head[run - 1]]]  # owners ascend within a run
    for r in np.unique(run[second[~equal]]):  # a collision of hashes: practically never
        best: dict[bytes, int] = {}
        members = order[run == r]
        for i in members:
            w = text[s[i] : e[i]]
            best[w] = min(best.get(w, LAST), int(owner[i]))
        for i in members:
            low[i] = best[text[s[i] : e[i]]]
    return low


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(breaks)
    return first, np.concatenate((first[1:], [n])) if len(first) else first


def _pack(heads: np.ndarray, text: bytes) -> bytes:
    """Compress a packet: (owner, key, first word, windows) of each string, column by column, and the strings.

    Strings of one document follow each other, so owner and key are stored once a document.
    """
    new = np.ones(len(heads), bool)
    new[1:] = (np.diff(heads[:, 0]) != 0) | (np.diff(heads[:, 1]) != 0)
    owner, key = heads[new, 0], heads[new, 1]
    columns = (np.diff(owner, prepend=np.int64(0)), key, new.astype(np.int8), heads[:, 2].astype("<i4"), heads[:, 3].astype("<i4"))
    raw = b"".join([struct.pack("<II", len(heads), len(owner)), *[c.tobytes() for c in columns], text])
    return zstandard.ZstdCompressor(level=6).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, docs = struct.unpack_from("<II", raw)
    at, columns = 8, []
    for kind, size in (("<i8", docs), ("<i8", docs), ("i1", n), ("<i4", n), ("<i4", n)):
        columns.append(np.frombuffer(raw, kind, size, at))
        at += columns[-1].nbytes
    delta, key, new, first, count = columns
    doc = np.cumsum(new, dtype=np.int64) - 1
    return np.stack([np.cumsum(delta)[doc], key[doc], first, count], axis=1) if n else np.zeros((0, 4), np.int64), raw[at:]


def _scan(n_buckets: int, k: int, flush_docs_bytes: int):
    """Map side: windows of a batch that an earlier document of the batch has are settled here; the
    others travel, as super-k-mers, in one compressed packet for each bucket."""

    def send(docs: list[bytes], owner: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads: list[list[np.ndarray]] = []
        block = Block(docs)
        words = block.word_hashes()
        at, h = block.windows(words, k)
        if not len(at):
            return
        own = owner[block.doc[at]]
        low = smallest_owner(block.text, block.start[at], block.end[at + k - 1], h, own)
        live = low == own
        # repeats inside the same document: one occurrence travels, and no removal follows from them here
        word0 = at - block.first[block.doc[at]]
        doc = block.doc[at]
        # settled windows, as ranges, go to a bucket of their document
        gone = np.flatnonzero(~live)
        if len(gone):
            brk = np.concatenate(([True], (np.diff(gone) > 1) | (np.diff(doc[gone]) != 0)))
            f, e = _runs(brk, len(gone))
            g = gone[f]
            settled = np.stack([owner[doc[g]], key[doc[g]], word0[g], -(word0[gone[e - 1]] + 1)], axis=1)
            to = (mix(key[doc[g]].astype(np.int64).view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        else:
            settled, to = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        # minimisers: the smallest hash of GRAM words in the window, the leftmost on ties
        gram = span_hashes(words, np.arange(len(words) - GRAM + 1), np.arange(GRAM, len(words) + 1))
        low32 = np.uint64(2**32 - 1)  # 32 bits of hash, then the place: alike in every block
        placed = (gram & ~low32) | np.arange(len(gram), dtype=np.uint64)
        place = (sliding_min(placed, k - GRAM + 1)[at] & low32).astype(np.int64)
        brk = np.ones(len(at), bool)
        brk[1:] = (np.diff(place) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0) | (live[1:] != live[:-1])
        f, e = _runs(brk, len(at))
        keep = live[f]
        f, e = f[keep], e[keep]
        bucket = (mix(gram[place[f]]) % np.uint64(n_buckets)).astype(np.int64)
        sent = np.stack([owner[doc[f]], key[doc[f]], word0[f], e - f], axis=1)
        s, t = block.start[at[f]], block.end[at[e - 1] + k - 1]
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        order2 = np.argsort(to, kind="stable")
        cuts2 = np.searchsorted(to[order2], np.arange(n_buckets + 1))
        out_b, out_p = [], []
        text = block.text
        for b in range(n_buckets):
            mine, other = order[cuts[b] : cuts[b + 1]], order2[cuts2[b] : cuts2[b + 1]]
            if len(mine) or len(other):
                body = b"\n".join([text[x:y] for x, y in zip(s[mine].tolist(), t[mine].tolist(), strict=True)])
                heads = np.concatenate([sent[mine], settled[other]])
                out_b.append(b)
                out_p.append(_pack(heads, body))
        yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_p, pa.binary())], ["bucket", "packet"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            docs = [canonical(x) for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
            for at, part in blocks(docs, flush_docs_bytes):
                yield from send(part, owner[at : at + len(part)], key[at : at + len(part)])

    return run


def _count(k: int):
    """Bucket side: all super-k-mers of a bucket; sorting their windows tells each window's smallest document."""

    def settle(packets: list[bytes]) -> pa.RecordBatch:
        # Of each packet only its text and a few numbers for each window stay in memory.
        texts, cols, ranges, base = [], [], [], 0
        for p in packets:
            head, body = _unpack(p)
            done = head[head[:, 3] < 0]
            if len(done):
                ranges.append(done * (1, 1, 1, -1))
            sent = head[head[:, 3] > 0]
            if len(sent):
                block = Block(body.split(b"\n"))
                at, h = block.windows(block.word_hashes(), k)
                doc = block.doc[at]
                place = sent[doc, 2] + at - block.first[doc]
                cols.append((block.start[at] + base, block.end[at + k - 1] + base, h, sent[doc, 0], sent[doc, 1], place))
                texts.append(block.text)
                base += len(block.text)
        if cols:
            s, e, h, own, key, place = (np.concatenate(c) for c in zip(*cols, strict=True))
            cols.clear()
            gone = np.flatnonzero(smallest_owner(b"".join(texts), s, e, h, own) < own)
            if len(gone):
                own, key, place = own[gone], key[gone], place[gone]
                brk = np.ones(len(gone), bool)
                brk[1:] = (np.diff(gone) > 1) | (np.diff(place) != 1) | (own[1:] != own[:-1]) | (key[1:] != key[:-1])
                f, e = _runs(brk, len(gone))
                ranges.append(np.stack([own[f], key[f], place[f], place[e - 1] + 1], axis=1))
        if not ranges:
            ranges.append(np.zeros((0, 4), np.int64))
        out = np.concatenate(ranges)
        # one row for each document: its ranges of window starts
        out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
        brk = np.ones(len(out), bool)
        brk[1:] = (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0)
        f, e = _runs(brk, len(out))
        spans = out[:, 2:].astype("<i4")
        packed = [spans[a:b].tobytes() for a, b in zip(f.tolist(), e.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out[f, 0]), pa.array(out[f, 1]), pa.array(packed, pa.binary())], ["owner", "key", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield settle(held)
                    held = []
                bucket = b
                held.append(p)
        if held:
            yield settle(held)

    return run


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            texts = batch.column(batch.num_columns - 2).cast(pa.large_binary()).to_pylist()
            spans = batch.column(batch.num_columns - 1).to_pylist()
            for text, parts in zip(texts, spans, strict=True):
                words = text.split() if text else []
                gone = 0
                if parts:
                    delta = np.zeros(len(words) + 1, np.int64)
                    for p in parts:
                        r = np.frombuffer(p, "<i4").reshape(-1, 2)
                        np.add.at(delta, r[:, 0], 1)
                        np.add.at(delta, r[:, 1] + k - 1, -1)
                    hit = np.cumsum(delta[:-1]) > 0
                    gone = int(hit.sum())
                    words = [w for w, x in zip(words, hit.tolist(), strict=True) if not x]
                kept.append(b" ".join(words))
                total.append(len(words) + gone)
                removed.append(gone)
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*own, text, pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                [*batch.schema.names[:-2], "kept_text", "n_words", "n_removed"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """``(doc_id, kept_text, n_words, n_removed)`` for each row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` words covers it that also starts in a document
    with a smaller doc_id; windows are judged on the input.  ``kept_text`` joins the
    other words by one space.

    Windows are dealt to buckets by their minimiser (smallest hash of ``GRAM`` words in
    them).  Consecutive windows with one minimiser travel as one packed string, so a word
    is sent about three times instead of ``window`` times.  A batch first settles what
    repeats within it, byte by byte: of equal windows only that of the smallest doc_id
    travels, so a passage that a third of all documents share reaches its bucket once a
    batch.  A bucket sorts its windows, compares neighbours byte by byte and returns
    ranges of removable windows, which are joined to the texts.

    ``buckets``: default four for each shuffle partition; a bucket is what one task holds at a
    time, so the number of shuffle partitions should follow the input's size.  Null texts and texts without words: no words, empty ``kept_text``.  Null
    doc_ids come after all others and are equal to each other.  Repeated rows, and rows
    that share a doc_id, don't remove each other's words.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = buckets or 4 * parts
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.col("text").cast("string")
    key = F.coalesce(F.xxhash64(text), F.lit(0))
    base = docs.select(own.alias("owner"), key.alias("key"), text.alias("text"))
    packets = base.where("text IS NOT NULL").mapInArrow(_scan(n, window, block_bytes), "bucket int, packet binary")
    dealt = packets.repartition(parts, "bucket").sortWithinPartitions("bucket")
    spans = dealt.mapInArrow(_count(window), "owner long, key long, spans binary")
    spans = spans.groupBy("owner", "key").agg(F.collect_set("spans").alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("owner"), key.alias("key"), text.alias("text"))
    joined = rows.join(spans, ["owner", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(window), "doc_id long, kept_text string, n_words long, n_removed long")
