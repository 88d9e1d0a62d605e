"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Block, Scratch, blocks, canonical, map_batches, marked, marks, mix, shuffle_partitions, slices, span_hashes, tidy
from corvane.llm.components import connected_components

SHINGLE = 5
_EMPTY = np.uint64(2**64 - 1)


def word_digests(block: Block) -> np.ndarray:
    """64-bit digests of a block's words: eight bytes at a time are mixed into the digest of what came before.

    Words of up to eight bytes have digests of their own; longer ones collide by chance alone, as each step is a
    mixing that isn't linear (sums of powers, by contrast, collide for words made to).  No table of words is kept.
    """
    lanes = np.ndarray(len(block.text), "<u8", block.text + bytes(8), strides=(1,))  # the eight bytes from each place on
    left = block.end - block.start
    h = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, live = block.start, np.arange(len(left))
    while len(live):
        lane, n = lanes[at], np.minimum(left, 8)
        lane &= np.uint64(2**64 - 1) >> (np.uint64(64) - (n * 8).astype(np.uint64))
        h[live] = mix(h[live] ^ lane)
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    return h


def shingle_sets(docs: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles (whole sequence if shorter)."""
    out: list[np.ndarray] = []
    for _, part in blocks(docs):
        block = Block(part)
        words = word_digests(block)
        at, h = block.windows(words, k)
        cut = np.searchsorted(at, block.first)
        for i in range(block.n_docs):
            if block.n_words[i] >= k:
                out.append(np.unique(h[cut[i] : cut[i + 1]]))
            elif block.n_words[i]:
                out.append(span_hashes(words, block.first[i : i + 1], block.first[i + 1 : i + 2]) ^ np.uint64(block.n_words[i]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def exact_sets(docs: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The same sets for documents that are compared: shingles numbered by their words themselves, so that none is taken for another."""
    number: dict[bytes, int] = {}
    size = np.zeros(len(docs), np.int64)
    ids = [np.zeros(0, np.int64)]
    for i, doc in enumerate(docs):  # words as objects of one text at a time
        words = doc.split()
        size[i] = len(words)
        if words:
            ids.append(np.array([number.setdefault(w, len(number) + 1) for w in [*words, *[b" "] * (k - len(words))]], np.int64))  # no word is a space
    ids = np.concatenate(ids)
    rows = np.maximum(size - k + 1, size > 0)  # a text shorter than k words is one shingle
    own = np.repeat(np.arange(len(docs)), rows)
    at = np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)
    padded = np.maximum(size, k * (size > 0))
    first = (np.cumsum(padded) - padded)[own] + at if len(own) else np.zeros(0, np.int64)
    code = ids[first] if len(own) else first
    for j in range(1, k):  # numbers of pairs, triples, ... of words, each from the one before
        code = np.unique(code * (len(number) + 1) + ids[first + j], return_inverse=True)[1]
    cut = np.concatenate(([0], np.cumsum(rows)))
    return [np.unique(code[x:y]).astype(np.uint64) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def fast_sketch(sets: list[np.ndarray], t: int, seed: int) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017) of many sets at once.

    In round i < t every element of a set falls into a hashed bin of t; in round
    t + j every element falls into bin j, so that each bin fills in the end.  A bin
    keeps the smallest (round, hash); a set leaves once its bins are full, mostly
    after O(log t) rounds.  Returns an array (sets, t) of 64-bit coordinates.
    """
    out = np.full((len(sets), t), _EMPTY, np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return out
    elem = np.concatenate([sets[i] for i in live])
    own = np.repeat(np.arange(len(live)), [len(sets[i]) for i in live])
    part = np.full((len(live), t), _EMPTY, np.uint64)
    for i in range(2 * t):
        h = mix(elem + np.uint64((seed + i * 0x9E3779B97F4A7C15) % 2**64))
        where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.uint64(i - t)
        value = (np.uint64(i) << np.uint64(48)) | (h & np.uint64(2**48 - 1))
        np.minimum.at(part.reshape(-1), own * t + where.astype(np.int64), value)
        open_ = (part == _EMPTY).any(axis=1)
        if open_.all():
            continue
        full = ~open_
        out[live[full]] = part[full]
        if full.all():
            return out
        stay = open_[own]
        renumber = np.cumsum(open_) - 1
        elem, own = elem[stay], renumber[own[stay]]
        live, part = live[open_], np.ascontiguousarray(part[open_])
    out[live] = part
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; equal coordinates in a band give equal keys."""
    s = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    h = np.tile(mix(np.arange(1, bands + 1).astype(np.uint64)), (len(sketch), 1))
    for r in range(rows):
        h = mix(h ^ s[:, :, r]) + np.uint64(r)
    return h.view(np.int64)


def _sketches(bands: int, rows: int, seed: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            # long texts come one at a time; a text's own arrays take some 60 bytes a word
            for at, part in blocks(canonical(x.lower()) if x else b"" for x in texts):
                sets = shingle_sets(part, k)
                keys = band_keys(fast_sketch(sets, bands * rows, seed), bands, rows)
                digest = [hashlib.blake2b(d, digest_size=16).digest() for d in part]  # of the words themselves
                key = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int64)
                full = [r if m else [] for r, m in zip(keys, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(n), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(full, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "hi", "lo", "bands"],
                )

    return tidy(run)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two lists of sets (or within one), by matrix products.

    Only elements that two sets share at least become columns; columns go by in
    strips, so memory depends on the number of sets and ``width`` alone.
    """
    sets = left + (right or [])
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, own = value[order], own[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col, minlength=1)[col] > 1 if len(col) else new
    col, own = col[shared], own[shared]
    if len(col):
        col = np.cumsum(np.concatenate(([True], col[1:] != col[:-1]))) - 1
    n = len(left)
    total = np.zeros((n, len(right) if right is not None else n), np.int64)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[own[a:b], col[a:b] - lo] = 1
        total += np.rint(m[:n] @ (m[n:] if right is not None else m).T).astype(np.int64)
    return total


def linking_forest(nodes: list[int], left: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the verified pairs connect: at most one fewer than there are sets.

    ``split`` 0: all pairs of the sets; else pairs of one of the first ``split`` with one of the rest.
    """
    size = np.array([len(s) for s in left], np.int64)
    if split:
        inter = overlaps(left[:split], left[split:])
        union = size[:split, None] + size[None, split:] - inter
        ok = (inter * 100 >= union * percent) & (inter > 0)
        pairs = np.argwhere(ok) + (0, split)
    else:
        inter = overlaps(left, None)
        union = size[:, None] + size[None, :] - inter
        pairs = np.argwhere(np.triu((inter * 100 >= union * percent) & (inter > 0), 1))
    root = list(range(len(left)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))
    return out


def _verify(percent: int, k: int):
    def settle(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r[0])
        split = sum(r[0] == 0 for r in rows) if rows[-1][0] else 0
        if rows[-1][0] and not split:
            return []
        sets = exact_sets([canonical(r[2].lower()) for r in rows], k)
        return linking_forest([r[1] for r in rows], sets, split, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

        key, rows, links = None, [], []
        for batch in (piece for whole in batches for piece in slices(whole, 3)):
            cols = [batch.column(i).to_pylist() for i in range(3)] + [batch.column(3).cast(pa.large_binary()).to_pylist()]
            for g, side, node, text in zip(*cols, strict=True):
                if g != key:
                    if len(rows) > 1:
                        links += settle(rows)
                    key, rows = g, []
                rows.append((side, node, text))
            if len(links) > 10_000:
                yield emit(links)
                links = []
        if len(rows) > 1:
            links += settle(rows)
        yield emit(links)

    return tidy(run)


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = SHINGLE,
    bands: int = 24,
    rows: int = 5,
    seed: int = 11,
    block_docs: int = 256,
    block_shingles: int = 250_000,
) -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``.

    Documents link when their sets of word shingles have a Jaccard similarity of
    ``percent``/100 at least; a component is what links connect, named by its smallest doc_id.

    1. One scan sketches every text: ``bands * rows`` coordinates, of which each
       band of ``rows`` becomes a key.  A pair at the threshold shares no key with
       probability (1 - 0.85^5)^24 < 1e-6.
    2. Equal word sequences collapse to one class.  Classes with a common key link to the
       smallest class with that key: a star, not pairs, so copies in any number cost one row each.
    3. Each class is first verified against the one star's centre with which it shares most keys: two texts, whatever the
       star's size.  That settles nearly all; components of these links are known.
    4. What may be left are links between different known components that share a key.  Keys whose classes are
       all in one component are done.  Classes of the other keys are verified with all of their candidate component: small ones in one
       block; larger ones by size level (sets that link have sizes within one level) and sub-blocks, block against block, so
       that a task holds two blocks at most, however large the component.
    5. Verification compares sets of the words themselves, not of hashes.  Tasks return spanning forests of
       verified links; their components are the result.

    Nulls and texts without words: set size 0, never linked.  Rows with one doc_id are one
    document.  A null doc_id is never linked, has a null component and is kept.  Other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = scratch.table(
        map_batches(rows_in, _sketches(bands, rows, seed, shingle), "doc_id long, n_shingles long, hi long, lo long, bands array<long>"),
        "sketches",
    )
    classes = (
        done.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"))
        .select("hi", "lo", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands"))
    )
    classes = scratch.table(classes, "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    shared = scratch.table(shared, "keys")  # as a table, so that the join below can be split at a hot key
    stars = scratch.table(keys.join(shared, "key"), "stars")  # (key, node, low)
    edges = scratch.table(stars.where("node > low").groupBy("node", "low").agg(F.count("*").alias("n")), "edges")
    member = scratch.table(connected_components(edges.select(F.col("node").alias("u"), F.col("low").alias("v")), scratch, "candidates"), "members")

    def verified(tasks: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Links among the texts of ``tasks(node, task, side)``; only texts that ``nodes(node)`` mark leave the place where they are read."""
        table = scratch.table(marks(nodes.select(F.xxhash64("node").alias("h")), "h"), f"{name}-marks")
        some = marked(rows_in.withColumn("__h", F.xxhash64("doc_id")), "__h", table).where("__marked AND text IS NOT NULL")
        texts = tasks.join(some, tasks.node == some.doc_id).select("task", "side", "node", "text")
        dealt = texts.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("task")
        return map_batches(dealt, _verify(percent, shingle), "u long, v long")

    # each class with the centre that shares most keys; a centre's classes in groups of block_docs and block_shingles
    best = edges.groupBy("node").agg(F.max(F.struct("n", (-F.col("low")).alias("low"))).alias("x")).select("node", (-F.col("x.low")).alias("low"))
    best = scratch.table(best.join(classes.select("node", "n"), "node"), "best")
    groups = best.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("groups"))
    task = F.expr("xxhash64(low, g)")
    around_ = best.join(groups, "low").withColumn("g", F.expr("CAST(pmod(xxhash64(node), groups) AS INT)")).select("node", task.alias("task"), F.lit(1).alias("side"))
    centres = groups.withColumn("g", F.explode(F.expr("sequence(0, groups - 1)"))).select(F.col("low").alias("node"), task.alias("task"), F.lit(0).alias("side"))
    first = scratch.table(verified(around_.unionByName(centres), best.select("node").union(best.select("low")), "first"), "first-links")
    known = scratch.table(connected_components(first, scratch, "first"), "known").withColumnRenamed("comp", "known")
    mixed = stars.join(known, "node", "left").groupBy("key").agg(*[f(F.coalesce("known", "node")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]).where("a < b")
    left = scratch.table(stars.join(mixed.select("key"), "key", "left_semi").select("node").distinct(), "left")

    # two classes that are a component of their own have been compared
    pairs = member.groupBy("comp").agg(F.count("*").alias("c")).where("c > 2").select("comp")
    sized = member.join(left, "node", "left_semi").join(pairs, "comp", "left_semi").join(classes.select("node", "n"), "node")
    level = F.floor(F.log(F.col("n")) / math.log(100 / (percent - 0.1))).cast("int")
    sized = sized.withColumn("level", level)
    count = sized.groupBy("comp", "level").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = count.groupBy("comp").agg(F.sum("c").alias("wc"), F.sum("s").alias("ws"))
    subs = F.greatest(F.ceil(F.col("c") / block_docs), F.ceil(F.col("s") / block_shingles)).cast("int")
    plan = count.join(whole, "comp").select(
        "comp", "level", ((F.col("wc") <= 2 * block_docs) & (F.col("ws") <= 2 * block_shingles)).alias("small"), subs.alias("subs")
    )
    plan = scratch.table(plan, "plan")
    around = (
        plan.where("NOT small")
        .select("comp", F.explode(F.array(*[F.struct((F.col("level") + d).alias("level"), F.lit(-d).alias("d"), "subs") for d in (-1, 0, 1)])).alias("x"))
        .groupBy("comp", "x.level")
        .agg(*[F.coalesce(F.max(F.when(F.col("x.d") == d, F.col("x.subs"))), F.lit(0)).alias(f"subs{i}") for i, d in enumerate((-1, 0, 1))])
    )
    around = scratch.table(around, "around")
    blocked = sized.join(plan.select("comp", "level", "small"), ["comp", "level"]).join(around, ["comp", "level"], "left")
    sub = F.expr("CAST(pmod(xxhash64(node), greatest(subs1, 1)) AS INT)")
    blocked = blocked.withColumn("sub", sub).selectExpr(
        "node",
        """CASE WHEN small THEN array(struct(xxhash64(comp) AS task, 0 AS side))
           ELSE concat(
             transform(sequence(0, subs1 - 1), s -> struct(xxhash64(comp, level, least(s, sub), level, greatest(s, sub)) AS task, CAST(sub > s AS INT) AS side)),
             CASE WHEN subs2 > 0 THEN transform(sequence(0, subs2 - 1), s -> struct(xxhash64(comp, level, sub, level + 1, s) AS task, 0 AS side)) ELSE array() END,
             CASE WHEN subs0 > 0 THEN transform(sequence(0, subs0 - 1), s -> struct(xxhash64(comp, level - 1, s, level, sub) AS task, 1 AS side)) ELSE array() END)
           END AS tasks""",
    )
    dealt = blocked.select("node", F.explode("tasks").alias("x")).select("node", "x.task", "x.side")
    links = known.select(F.col("node").alias("u"), F.col("known").alias("v")).union(verified(dealt, left, "left"))  # what is settled comes as stars
    # Rows of one doc_id with different texts are one document: their classes are linked too.
    named = scratch.table(done.drop("bands").join(classes.select("hi", "lo", "node"), ["hi", "lo"], "left").drop("hi", "lo"), "rows")
    several = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared_ids = named.join(several, "doc_id").where("node > low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    found = scratch.table(connected_components(links.union(shared_ids), scratch, "links"), "found")

    joined = named.join(found, "node", "left")
    comp = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("comp", "node")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
