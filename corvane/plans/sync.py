"""Incremental indexing: files against a manifest."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions.text import base_name, enriched, entity_id, glob_match, stem
from corvane.operators.bm25 import index_of, lengths_of, postings_of, tokenised
from corvane.operators.embedding import Embedder, embed
from corvane.operators.structured import chunk_files
from corvane.sources.snapshots import Store, delete, upsert

CHUNKS = """chunk_id string, source string, chunk_index int, file_extension string, file_hash string, content string,
    doc_text string, position_start long, position_end long, metadata map<string,string>, embedding array<float>"""
MANIFEST = "rel string, file_hash string, n_chunks long"
POSTINGS = "term string, id string, tf long, dl long"
LENGTHS = "id string, dl long"

log = logging.getLogger(__name__)


def diff_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(rel, file_hash, old_hash, status)``: new, changed, unchanged or removed; a full outer join on ``rel``."""
    old = manifest.select("rel", F.col("file_hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("file_hash").isNull(), "removed")
        .when(F.col("file_hash") == F.col("old_hash"), "unchanged")
        .otherwise("changed")
    )
    return files.select("rel", "file_hash").join(old, "rel", "full_outer").select("rel", "file_hash", "old_hash", status.alias("status"))


def index_chunks(files: DataFrame, settings: Settings) -> DataFrame:
    """Chunk rows of ``files(rel, ext, file_hash, text)``, with ids and the enriched text that is searched."""
    parts = chunk_files(files, settings).join(files.select("rel", "ext", "file_hash"), "rel")
    parts = parts.withColumn("name", base_name("rel")).withColumn("stem", stem("name"))
    prose = F.col("ext").isin(".md", ".txt")
    parts = parts.withColumn("entity", F.when(prose, entity_id("name")))
    return parts.select(
        F.concat("rel", F.lit("::chunk-"), "chunk_index").alias("chunk_id"),
        F.col("rel").alias("source"),
        "chunk_index",
        F.col("ext").alias("file_extension"),
        "file_hash",
        "content",
        enriched("content", "entity", "stem").alias("doc_text"),
        "position_start",
        "position_end",
        "metadata",
    )


@dataclass(frozen=True)
class Synced:
    indexed: int
    removed: int
    unchanged: int
    total_chunks: int


def _live(store: Store, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Chunks, manifest, postings and lengths of the live version; None if there is none for this folder or it can't be read."""
    try:
        meta = store.meta()
        if meta is None or meta["source_folder"] != folder:
            return None
        tables = tuple(store.table(n, schema) for n, schema in (("chunks", CHUNKS), ("manifest", MANIFEST), ("postings", POSTINGS), ("lengths", LENGTHS)))
        for t in tables:
            t.agg(F.count(t.columns[-1])).first()  # a damaged file shows here
        return tables
    except Exception:  # noqa: BLE001  whatever the reader raises, the index is built anew
        log.exception("the index in %s can't be read; indexing from nothing", store.root)
        return None


def sync(store: Store, files: DataFrame, folder: str, glob: str = "*", settings: Settings = Settings(), embedder: Embedder | None = None) -> Synced:  # noqa: B008
    """Bring the index to the state of ``files``; only new and changed files are chunked, embedded and tokenised.

    Another folder than the live version's starts from nothing, and so does an index that can't be read.  Files outside ``glob``
    are left as they are.  All chunks of a changed file are replaced; removed files leave chunks, postings and manifest.
    New chunks are written, with their vectors, before anything is derived from them, so ``embedder`` sees each
    once; postings of other chunks are kept.  The pointer is written last.
    """
    spark = files.sparkSession
    live = _live(store, folder)
    chunks, manifest, postings, lengths = live or [spark.createDataFrame([], x) for x in (CHUNKS, MANIFEST, POSTINGS, LENGTHS)]
    in_scope = manifest.withColumn("__n", base_name("rel")).where(glob_match("__n", glob)).drop("__n")
    version = store.new_version()
    status = store.stage(version, "status", diff_manifest(files, in_scope))
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}  # four rows at most
    changed, gone = status.where("status IN ('new', 'changed')"), status.where("status = 'removed'")
    if live is None or counts.keys() - {"unchanged"}:
        todo = files.join(changed.select("rel"), "rel", "left_semi")
        fresh = index_chunks(todo, settings)
        fresh = embed(fresh, "doc_text", embedder) if embedder else fresh.withColumn("embedding", F.lit(None).cast("array<float>"))
        fresh = store.stage(version, "fresh", fresh)
        touched = changed.select(F.col("rel").alias("source")).union(gone.select("rel"))
        old_ids = chunks.join(touched.distinct(), "source", "left_semi").select(F.col("chunk_id").alias("id"))
        store.stage(version, "chunks", delete(chunks, touched, "source").unionByName(fresh))
        n = fresh.groupBy(F.col("source").alias("rel")).agg(F.count("*").alias("n_chunks"))
        rows = changed.select("rel", "file_hash").join(n, "rel", "left").select("rel", "file_hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        store.stage(version, "manifest", upsert(delete(manifest, gone, "rel"), rows, "rel"))
        words = tokenised(fresh, "chunk_id", "doc_text")
        postings = store.stage(version, "postings", delete(postings, old_ids, "id").unionByName(postings_of(words)))
        lengths = store.stage(version, "lengths", delete(lengths, old_ids, "id").unionByName(lengths_of(words)))
        index = index_of(postings, lengths)
        store.stage(version, "terms", index.terms)
        store.stage(version, "corpus", index.corpus)
        store.publish(version, folder)
        store.discard(f"{version}/fresh")
        store.discard(f"{version}/status")
    else:
        store.discard(version)
    total = store.table("chunks", CHUNKS).count()
    return Synced(counts.get("new", 0) + counts.get("changed", 0), counts.get("removed", 0), counts.get("unchanged", 0), total)
