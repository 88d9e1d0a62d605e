"""The four verbs: index a folder, find documents, ask a question, tell the state.  None of them raises."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.operators.bm25 import Index, query_terms, score, top_k
from corvane.operators.embedding import Embedder
from corvane.operators.fusion import fuse
from corvane.operators.vectors import nearest, similarity
from corvane.plans.loop import ChatModel, StubModel, answer_question
from corvane.plans.sync import CHUNKS, sync
from corvane.sources.files import scan_folder
from corvane.sources.snapshots import Store

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Indexed:
    indexed_count: int
    total_chunks: int
    message: str


@dataclass(frozen=True)
class Answer:
    answer: str
    #: The relevant passages, best first.
    sources: list[dict] = field(default_factory=list)

    @property
    def source_files(self) -> list[str]:
        """Their files, each once, in the same order."""
        return list(dict.fromkeys(r["source"] for r in self.sources))


@dataclass(frozen=True)
class Status:
    is_indexed: bool
    indexed_count: int
    total_chunks: int
    persist_dir: str
    indexed_at: object = None


class Engine:
    """An index in ``root`` (any folder Spark can write to)."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), model: ChatModel | None = None, embedder: Embedder | None = None):  # noqa: B008
        self.spark, self.settings, self.store = spark, settings, Store(spark, root)
        self.model = model or StubModel()
        self.embedder = embedder

    def search(self, query: str, k: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
        """``(rank, chunk_id, source, content, position_start, position_end, metadata, score)``; raises on a bad k."""
        k = self.settings.default_results if k is None else k
        if k < 1:
            raise ValueError("top_k must be positive")
        chunks = self.store.table("chunks", CHUNKS)
        meta = self.store.meta()
        if meta is None:
            return chunks.select(F.lit(0).alias("rank"), "chunk_id", "source", "content", "position_start", "position_end", "metadata", F.lit(0.0).alias("score"))
        index = Index.load(self.spark, f"{self.store.root}/{meta['snapshot']}")
        asked = query_terms(self.spark.createDataFrame([(0, query)], "qid long, text string"))
        lists = [score(index, asked)]
        if self.embedder is not None:
            q = self.spark.createDataFrame([(0, self.embedder([query])[0])], "qid long, q array<double>")
            near = nearest(chunks.where("embedding IS NOT NULL"), q, self.settings.oversample * k, id_="chunk_id")
            lists.append(near.select("qid", "id", similarity("distance").alias("score")))
        ranked = top_k(fuse(lists, self.settings.rrf_k), k, exclude=exclude)
        best = ranked.select("rank", F.col("id").alias("chunk_id"), "score")
        return chunks.join(F.broadcast(best), "chunk_id").select("rank", "chunk_id", "source", "content", "position_start", "position_end", "metadata", "score")  # k rows

    def index_folder(self, path: str, glob_pattern: str = "*") -> Indexed:
        try:
            files = scan_folder(self.spark, path, glob_pattern, self.settings.extensions)
            done = sync(self.store, files, path, glob_pattern, self.settings, self.embedder)
            return Indexed(done.indexed + done.unchanged, done.total_chunks, f"{done.indexed} files indexed, {done.unchanged} unchanged, {done.removed} removed")
        except Exception as e:  # noqa: BLE001
            log.exception("indexing failed")
            return Indexed(0, 0, f"Error: {e}")

    def find_relevant_docs(self, query: str, top_k: int | None = None) -> list[dict]:
        try:
            return [r.asDict() for r in self.search(query, top_k).orderBy("rank").collect()]
        except Exception:  # noqa: BLE001
            log.exception("search failed")
            return []

    def files(self) -> DataFrame | None:
        """The indexed folder's files as they are now (answers show whole files); None if there is no such folder any more."""
        meta = self.store.meta()
        try:
            return meta and scan_folder(self.spark, meta["source_folder"], extensions=self.settings.extensions).select("rel", "text")
        except (FileNotFoundError, NotADirectoryError):
            log.warning("%s is gone; answers show chunks", meta["source_folder"])
            return None

    def ask_question(self, query: str) -> Answer:
        try:
            state = answer_question(self.spark, query, self.search, self.model, self.files(), self.settings)
            return Answer(state.answer, state.relevant)
        except Exception as e:  # noqa: BLE001
            log.exception("answering failed")
            return Answer(f"Error: {e}")

    def get(self, chunk_id: str) -> dict | None:
        """The chunk with this id; None if there is none."""
        row = self.store.table("chunks", CHUNKS).where(F.col("chunk_id") == chunk_id).first()
        return row and row.asDict()

    def clear(self) -> None:
        """Forget the index: chunks, manifest, postings and the pointer to them."""
        self.store.clear()

    def index_status(self) -> Status:
        try:
            meta = self.store.meta()
            row = self.store.table("chunks", CHUNKS).agg(F.countDistinct("source").alias("s"), F.count("*").alias("n")).first()
            return Status(meta is not None, row["s"], row["n"], self.store.root, meta and meta["indexed_at"])
        except Exception:  # noqa: BLE001
            log.exception("no status")
            return Status(False, 0, 0, self.store.root)
