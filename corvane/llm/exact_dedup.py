"""Exact duplicates through an extendible-hash index on shared files, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, marked, marks, shuffle_partitions

#: Bits of a key, and bits by which overfull buckets are looked at anew in one pass over the keys.
KEY_BITS, STEP = 64, 8
#: A bucket's capacity grows with the input so that the directory has about 2 ** (DIRECTORY_BITS + 1) buckets at most.
DIRECTORY_BITS = 16


def _prefix(h: str, depth: int) -> Column:
    return F.expr(f"shiftrightunsigned({h}, {KEY_BITS - depth})") if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Extendible-hash directory of distinct 64-bit keys ``keys(h)``: ``(depth, prefix, n)``, one row a bucket that holds keys.

    A bucket of depth d holds the keys that begin with one prefix of d bits: a range of keys.  It splits, which doubles the
    part of the directory above it, while more than ``capacity`` keys are in it; no depth ends that, since 64 bits part any two keys.
    A pass counts prefixes ``STEP`` bits longer, of the keys in buckets still overfull alone.
    """
    rows, done, depth = keys.select("h"), None, 0
    while True:
        deep = min(depth + STEP, KEY_BITS)
        fine = rows.groupBy(_prefix("h", deep).alias("p")).agg(F.count("*").alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d"), "p", "n")
        levels = levels.groupBy("d", F.expr(f"shiftrightunsigned(p, {deep} - d)").alias("p")).agg(F.sum("n").alias("n"))
        levels = scratch.table(levels, f"levels-{deep}")
        over = levels.where(F.col("n") > capacity).select(F.col("d").alias("od"), F.col("p").alias("op"))
        # a bucket is a prefix whose keys fit while those of the prefix one bit shorter don't
        fits = levels.where(F.col("n") <= capacity)
        split = fits.join(over, (F.col("od") == F.col("d") - 1) & (F.col("op") == F.expr("shiftrightunsigned(p, 1)")), "left_semi")
        found = split if depth else fits.where("d = 0").unionByName(split)
        done = found if done is None else done.unionByName(found)
        left = over.where(F.col("od") == deep).select(F.col("op").alias("p"))
        if deep == KEY_BITS or left.isEmpty():
            return scratch.table(done.select(F.col("d").alias("depth"), F.col("p").alias("prefix"), "n"), "directory")
        rows, depth = rows.join(left, _prefix("h", deep) == F.col("p"), "left_semi"), deep


def in_buckets(df: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """``df(h, ...)`` with ``bucket``, the smallest key that its bucket may hold: each key meets the one prefix of its that is in the directory."""
    asked = df.withColumn("__at", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _prefix("h", d).alias("p")) for d in depths])))
    table = F.broadcast(buckets.select("depth", "prefix"))  # see DIRECTORY_BITS
    out = asked.join(table, (F.col("__at.d") == F.col("depth")) & (F.col("__at.p") == F.col("prefix")))
    low = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(prefix, {KEY_BITS} - depth)"))
    return out.withColumn("bucket", low).drop("__at", "depth", "prefix")


def exact_duplicates(docs: DataFrame, capacity: int = 32_768) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs(doc_id, text)``.

    Rows are one group when their texts have the same bytes; the largest doc_id stays.

    1. One scan keeps doc_id, 64-bit hash and SHA-256 of each row, in a narrow table.
    2. Its distinct hashes are the keys of an extendible-hash index: the directory doubles where more than ``capacity``
       keys share a bucket (:func:`directory`).
    3. Texts whose hash only one row has are alone.  The others (their hashes are a broadcast set of fixed size, so
       that other texts stay where they are) are compared byte by byte: grouped by the text itself, pre-aggregated where they are
       read, so that a group of any size comes as one row a task.
    4. Each owner task takes a range of buckets, numbers the entries that share a hash as a chain, and writes them in key order to
       the shared folder: that is the index.
    5. Each row looks up its bucket in the directory and its entry there, by hash and, along a chain, SHA-256.  ``keep_id`` and ``group_size`` are
       the entry's.  Only narrow rows take part; Spark splits a hot key (skew join).

    Null texts count as empty; very long texts need the memory of one text.  Null doc_ids
    are smaller than any other; a group of nulls alone keeps one of them as null.  Of rows that share the
    kept doc_id each is kept; fully repeated rows are copies like others, with one doc_id.  Other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    narrow = scratch.table(rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256")), "rows")
    keys = narrow.groupBy("h").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256"))
    keys = scratch.table(keys, "keys")
    several = keys.where("group_size > 1").select("h")
    capacity = max(capacity, keys.count() >> DIRECTORY_BITS)
    buckets = directory(keys, capacity, scratch)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # 65 at most

    alike = marked(rows, "h", scratch.table(marks(several, "h"), "marks")).where("__marked")
    groups = alike.groupBy("h", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = groups.select("h", "group_size", "keep_id", F.sha2("text", 256).alias("text_sha256")).join(several, "h", "left_semi")
    entries = keys.where("group_size = 1").select("h", "group_size", "keep_id", "text_sha256").unionByName(groups)
    owned = in_buckets(entries, buckets, depths).repartitionByRange(shuffle_partitions(spark), "bucket") if depths else entries.withColumn("bucket", F.col("h"))
    chain = F.expr("row_number() OVER (PARTITION BY bucket, h ORDER BY text_sha256)")
    index = owned.withColumn("chain", chain).select("bucket", "h", "chain", "text_sha256", "keep_id", "group_size")
    index = scratch.table(index.sortWithinPartitions("bucket", "h", "chain"), "index")
    asked = in_buckets(narrow, buckets, depths) if depths else narrow.withColumn("bucket", F.col("h"))
    out = asked.join(index, ["bucket", "h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
