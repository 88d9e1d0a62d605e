"""Shards by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import shuffle_partitions


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the largest score w / -ln(u), u being a hash of (key, shard) in (0, 1).

    Each shard's score depends on key, shard and its weight alone.  So a new shard only takes the
    keys for which it scores highest, and a removed shard's keys alone move.  Equal scores: the smaller shard.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    # 52 bits of a hash, as a number strictly between 0 and 1
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(key, s), 12).cast("double") + 0.5) / float(2**52)
    score = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(-(F.get(w, s) / F.log(u(s))), -s))
    return -F.array_max(score)["col2"]


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs(doc_id, text)``.

    ``shard`` follows from doc_id, the number of shards and their weights (law ``key``); ``grown_shard``
    is the shard with one shard more, of ``grown_weight``: the same or the new one.  ``size`` is the text's UTF-8
    bytes plus 16; a null text has none (16, and the CRC-32 of no bytes, 0).  ``slot`` counts a shard's rows from 0 without gaps.

    Slots need no shard in one task: a shard's rows are dealt to sub-buckets by a hash of all that
    identifies them; counts of sub-buckets (shards times sub-buckets, whatever the input) give each its
    first slot, and rows are numbered within sub-buckets.  Rows equal in doc_id, size and CRC are
    interchangeable.  A null doc_id is a key like any other.  Equal texts with different doc_ids may part: only the key counts.
    """
    weights = list(weights or [1.0] * shards)
    subs = 4 * shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("shard", rendezvous(key, weights)).withColumn("grown_shard", rendezvous(key, [*weights, grown_weight]))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(7)), F.lit(subs)).cast("int"))
    counts = rows.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    first = F.expr("coalesce(sum(n) OVER (PARTITION BY shard ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = F.broadcast(counts.select("shard", "sub", first.alias("first")))  # shards * subs rows at most
    place = F.expr("row_number() OVER (PARTITION BY shard, sub ORDER BY doc_id, size, text_crc32)")
    out = rows.withColumn("place", place).join(starts, ["shard", "sub"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("place") - 1).alias("slot"),
        "grown_shard",
    )
