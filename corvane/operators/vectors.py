"""Nearest neighbours among embedding columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.scratch import Scratch, spread

#: Query vectors in a block, and vectors in a packed row.
BLOCK, PACK = 8192, 1024
#: Bytes of query blocks that are sent to all tasks; beyond, blocks meet the vectors through a shuffle.
MAX_BROADCAST = 64 << 20


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)")


def norm(a: str) -> Column:
    return F.expr(f"sqrt(aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))")


def distance(a: str, b: str, metric: str = "cosine") -> Column:
    """``cosine``: 1 - cos, ``l2``: squared difference, ``ip``: 1 - dot product."""
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, x) -> s + x)")
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def similarity(distance_: str) -> Column:
    """1 / (1 + distance); a missing distance gives 0."""
    d = F.col(distance_)
    return F.when(d.isNull(), 0.0).otherwise(1 / (1 + d))


def _pack(rows: int):
    """Rows ``(id, v)`` as rows of up to ``rows`` ids and one matrix; vectors of another length start a matrix of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) > 0 for v in pdf["v"]]]
            for n, part in pdf.groupby(pdf["v"].map(len)):
                for lo in range(0, len(part), rows):
                    some = part.iloc[lo : lo + rows]
                    matrix = np.stack(some["v"].to_numpy()).astype(np.float64)
                    yield pd.DataFrame({"ids": [some["id"].tolist()], "m": [matrix.tobytes()], "n": [int(n)]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(qid, id, distance, rank)``: the k vectors nearest to each of ``queries(qid, q)``; ties go to the smaller id.

    Queries are a stated set: packed, ``BLOCK`` a row, into a table of matrices that never comes to the driver.  Vectors are packed
    where they are read.  Each pair of matrices of one width is one matrix product that keeps its own k best for each query, so
    what is shuffled is k rows a query and pack.  Blocks are broadcast while they have ``MAX_BROADCAST`` bytes at most (counted first).
    Vectors that are null or of another length are left out.
    """
    spark = vectors.sparkSession
    kind, qkind = vectors.schema[id_].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    asked = queries.select(F.col("qid").alias("id"), F.col("q").alias("v")).repartition(max(1, -(-queries.count() // BLOCK)), "qid")
    blocks = asked.mapInPandas(_pack(BLOCK), f"ids array<{qkind}>, m binary, n int")
    blocks = Scratch(spark, "asked").table(blocks.select(F.col("ids").alias("qids"), F.col("m").alias("q"), "n"), "blocks")
    small = (blocks.agg(F.sum(F.octet_length("q"))).first()[0] or 0) <= MAX_BROADCAST
    packed = spread(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v"))).mapInPandas(_pack(PACK), f"ids array<{kind}>, m binary, n int")
    pairs = packed.join(F.broadcast(blocks) if small else blocks, "n").select("qids", "q", "ids", "m", "n")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qids, q, ids, m, n in pdf.itertuples(index=False):
                q, v, own = np.frombuffer(q).reshape(-1, n), np.frombuffer(m).reshape(-1, n), np.asarray(ids)
                if metric == "l2":
                    d = (q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T
                else:
                    d = q @ v.T
                    if metric == "cosine":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            d = d / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None])
                    d = 1 - d
                d = np.round(d, 6) + 0.0
                by_id = np.argsort(own, kind="stable")
                order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]  # by distance, then id; a missing distance is last
                found = np.take_along_axis(d, order, axis=1)
                ok = ~np.isnan(found)
                yield pd.DataFrame({"qid": np.repeat(np.asarray(qids), ok.sum(axis=1)), "id": own[order[ok]], "distance": found[ok]})

    found = pairs.mapInPandas(best, f"qid {qkind}, id {kind}, distance double")
    rank = F.expr("row_number() OVER (PARTITION BY qid ORDER BY distance, id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
