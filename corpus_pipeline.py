"""Training-data pipeline over ``documents``: each stage works on all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, without
from corvane.llm.contamination import clean_documents
from corvane.llm.language_id import UNDETERMINED, predict, train
from corvane.llm.mixing import mix_sources
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.queries import byte_bpe
from corvane.llm.token_output import tokenised

#: SQL can't express sketches, trained models or tokenizers; tests hold run() against brute force.
ORACLE_SQL = None


#: A document stays if one language has this share of the posterior at least.
LEAST_POSTERIOR = 0.5


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the model is sure: one learned language has half of the posterior or more.

    Texts without a letter, empty and null ones go, and texts torn between languages.  A null ``lang`` is filled with the language found.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    known = predict(docs, model, names=("__lang", "__score")).where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_POSTERIOR))
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*columns(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets link at 0.8 or more; texts of documents that stay are not shuffled."""
    scratch = Scratch(spark, "kept")
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80, bands=32, rows=4).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = scratch.table(gone.withColumn("__hash", F.xxhash64("__gone")), "gone")
    return without(docs, F.xxhash64(F.col("doc_id").cast("long")), gone, "__hash", F.col("doc_id") == F.col("__gone"), scratch).select(*columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 13 benchmark words occurs, nor shorter items over a twentieth of their words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean_documents(docs, items, whole=True).select(*columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources with weights 1, 2, 3: a document comes as often as the mix takes it."""
    row = F.struct(*columns(docs)).alias("__row")  # all columns pass, whatever their names
    mixed = mix_sources(docs.select("doc_id", "text", "source", row), weights=(1, 2, 3), limit=3).where("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"__row.`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, written as sorted-string-table shards and read back."""
    out = tokenised(docs.select("doc_id", "text"), byte_bpe(), end=0)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
