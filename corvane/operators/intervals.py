"""Merging of chunks whose ranges meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def islands(df: DataFrame, source: str = "source", start: str = "position_start", end: str = "position_end") -> DataFrame:
    """Add ``island`` and ``reach``: ranges of one source that overlap, touch or leave one character between them share the first; the second is the end reached before the range."""
    order = f"PARTITION BY {source} ORDER BY {start}, {end}"
    reach = F.expr(f"max({end}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    flagged = df.withColumn("reach", reach).withColumn("__new", F.when(F.col(start) <= F.col("reach") + 1, 0).otherwise(1))
    return flagged.withColumn("island", F.expr(f"sum(__new) OVER ({order} ROWS UNBOUNDED PRECEDING)")).drop("__new")


def merge_chunks(df: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """One row an island: ``source, position_start, position_end, joined_from, content``; rows without a source or offset come unchanged.

    The merged text writes what overlaps once: each further chunk adds what lies behind the end reached so far.  Chunks lose
    what was written before they are gathered, and their rest is joined once, so the work grows with the text.  A column
    ``metadata``, if there is one, comes from the source's first chunk.
    """
    own = ["metadata"] if "metadata" in df.columns else []
    whole = F.col(source).isNotNull() & F.col("position_start").isNotNull() & F.col("position_end").isNotNull()
    parts = islands(df.where(whole), source)
    if own:
        parts = parts.withColumn("metadata", F.expr(f"first(metadata) OVER (PARTITION BY {source} ORDER BY position_start, position_end)"))
    added = F.when(F.col("position_start") <= F.col("reach") + 1, F.expr(f"substring({content}, CAST(greatest(reach - position_start, 0) AS INT) + 1)")).otherwise(F.col(content))
    merged = parts.groupBy(source, "island").agg(
        F.min("position_start").alias("position_start"),
        F.max("position_end").alias("position_end"),
        F.count("*").alias("joined_from"),
        F.sort_array(F.collect_list(F.struct(F.col("position_start").alias("a"), F.col("position_end").alias("b"), added.alias("c")))).alias("parts"),
        *[F.first(c).alias(c) for c in own],
    )
    text = F.array_join(F.transform("parts", lambda x: x["c"]), "")
    merged = merged.select(source, "position_start", "position_end", "joined_from", text.alias("content"), *own)
    loose = df.where(~whole).select(source, "position_start", "position_end", F.lit(1).cast("long").alias("joined_from"), F.col(content).alias("content"), *own)
    return merged.unionByName(loose)
