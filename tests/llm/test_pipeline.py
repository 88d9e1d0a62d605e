"""The pipeline's stages on the driver's smallest tables, each against a plain restatement on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "token_output":
            assert docs.count() == len(before)
            break
        assert docs.columns == columns
        after = Counter(r["doc_id"] for r in docs.collect())
        kept[name] = after
        if name == "language_id":
            assert after == Counter(i for i, t in before if t and any(c.isalpha() for c in t))
        elif name == "near_duplicates":
            assert after == Counter(i for i, _, _, k in brute.near(before, 80) if k)
        elif name == "decontamination":
            assert after == Counter(x[0] for x in brute.contamination(before, items) if not x[2])  # items have 13 words or more
        elif name == "mixing":
            assert set(after) <= {i for i, _ in before} and max(after.values()) <= 3
    total = corpus_pipeline.run(spark, sf).count()
    assert total == sum(kept["mixing"].values())


def test_clashing_columns_pass_through(spark, tmp_path):
    """Stages hand on columns that bear the names of their own."""
    names = ["size", "source_size", "target", "copies", "taken", "lang_pred", "score", "key", "h", "w", "n_words", "kept", "node", "__row2", "bucket", "slot", "bits"]
    texts = [f"the quick brown fox number {i} jumps over the lazy dog and runs away to the hills {i * 7}" for i in range(12)] + [None, "", "123 456"]
    rows = [(i, t, None if i == 3 else "en", "ab"[i % 2], *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"{n} string" for n in names]]))
    spark.createDataFrame([(1, "nothing of this kind stands in any of the documents that are read here today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names), name
        if name == "language_id":
            assert {r["doc_id"] for r in got} == set(range(12)) and {r["lang"] for r in got} == {"en"}
