"""Index, search, fusion, merging, the corrective loop and the facade."""

import shutil

import pytest
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.config import Settings
from corvane.operators import bm25, vectors
from corvane.operators.embedding import HashedWords
from corvane.operators.fusion import fuse
from corvane.operators.intervals import merge_chunks
from corvane.operators.running import earlier_sum
from corvane.plans import etl
from corvane.plans.loop import State, StubModel, answer_question, context, grade, route
from corvane.streaming.ingest import chunk_stream, start

RANKED = "qid long, id string, score double"


def test_fusion_by_score_ratio(spark):
    v = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.5), (1, "C", 0.1)], RANKED)
    b = spark.createDataFrame([(1, "B", 0.8), (1, "C", 0.4), (1, "D", 0.2)], RANKED)
    got = {r["id"]: r["score"] for r in fuse([v, b], digits=7).collect()}
    assert got == {"B": 0.0278877, "C": 0.0197609, "A": 0.0163934, "D": 0.009434}
    (one,) = fuse([v.where("id = 'A'"), b.limit(0)]).collect()
    assert one["score"] > 0
    ordinal = {r["id"]: r["score"] for r in fuse([v, b], method="ordinal", digits=7).collect()}
    assert ordinal["B"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)


def test_bm25_top_k_and_exclusions(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "red red pear", "green pear", "", None, "blue plum", "grey stone"])], "doc_id long, text string")
    index = bm25.build_index(docs)
    assert index.corpus.first()["n"] == 7
    asked = bm25.query_terms(spark.createDataFrame([(1, "red pear pear")], "qid long, text string"))
    rows = bm25.top_k(bm25.score(index, asked), 2).orderBy("rank").collect()
    assert rows[0]["id"] == 1 and len(rows) == 2
    without = bm25.top_k(bm25.score(index, asked), 2, exclude=spark.createDataFrame([(1,)], "id long")).collect()
    assert {r["id"] for r in without} == {0, 2}


def test_nearest_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, q array<double>")
    for metric in ("cosine", "l2", "ip"):
        got = {r["id"]: r["distance"] for r in vectors.nearest(v, q, 3, metric).collect()}
        native = v.where("size(embedding) = 2").crossJoin(q).select("vec_id", vectors.distance("q", "embedding", metric).alias("d")).collect()
        expected = {r["vec_id"]: r["d"] for r in native}
        assert all(d == pytest.approx(expected[i], abs=1e-6) for i, d in got.items()) and list(got)[0] in (0, 2)
    assert vectors.nearest(v, q.limit(0), 3).collect() == []


def test_merge_of_ranges(spark):
    rows = [("f", 0, 6, "abcdef"), ("f", 4, 9, "efghi"), ("f", 10, 12, "jk"), ("f", 20, 22, "zz"), ("g", 5, 9, "gggg"), (None, 1, 2, "n"), ("h", None, None, "p")]
    df = spark.createDataFrame(rows, "source string, position_start long, position_end long, content string")
    got = {(r["source"], r["position_start"], r["position_end"], r["joined_from"], r["content"]) for r in merge_chunks(df).collect()}
    assert got == {("f", 0, 12, 3, "abcdefghijk"), ("f", 20, 22, 1, "zz"), ("g", 5, 9, 1, "gggg"), (None, 1, 2, 1, "n"), ("h", None, None, 1, "p")}
    told = merge_chunks(df.withColumn("metadata", F.create_map(F.lit("from"), "content"))).collect()
    assert {(r["source"], r["position_start"]): r["metadata"]["from"] for r in told} == {("f", 0): "abcdef", ("f", 20): "abcdef", ("g", 5): "gggg", (None, 1): "n", ("h", None): "p"}


def test_running_sums_over_blocks(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7).alias("v"))
    for g in ("a", "b"):
        total = 0
        for r in earlier_sum(df, ["g"], "id", "v", "s", block=64).where(F.col("g") == g).orderBy("id").collect():
            assert r["s"] == total
            total += r["v"]


def test_route_and_search_query():
    s = Settings()
    assert [route(3, 0, s), route(1, 0, s), route(0, 2, s), route(0, 1, s)] == ["answer", "broaden", "answer", "broaden"]
    assert State(" q ").search_query() == "q" and State("q", "r", "  ").search_query() == "r"


def test_grading_survives_a_failing_model(spark):
    class Failing:
        def __call__(self, prompt):
            if "bad" in prompt:
                raise RuntimeError
            return "relevant: yes\nscore: 0.7"

    chunks = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", "  "), ("d", None)], "source string, content string")
    got = {r["source"]: (r["relevant"], r["score"]) for r in grade(chunks, "q", Failing()).collect()}
    assert got == {"a": (True, 0.7), "b": (False, 0.0), "c": (False, 0.0), "d": (False, 0.0)}


def test_loop_is_bounded_and_falls_back(spark):
    asked = []

    def search(query, k):
        asked.append((query, k))
        return spark.createDataFrame([("s", "unrelated", 0, 9, 1.0)], "source string, content string, position_start long, position_end long, score double")

    state = answer_question(spark, "zebra", search, StubModel())
    assert state.retrievals == 3 and state.broaden_count == 2 and state.relevant == []
    assert "don't answer" in state.answer and asked[2][1] == asked[0][1] + 1


def test_context_prefers_whole_files_for_short_chunks():
    rows = [{"source": "a", "content": "short", "position_start": 0, "position_end": 5}, {"source": "b", "content": "x" * 20}]
    assert context(rows, {"a": "whole file", "b": "other"}, 10) == "[Source 1: a [chars 0-5]]\nwhole file\n\n---\n\n[Source 2: b]\n" + "x" * 20


def test_quotas_and_templates():
    assert sum(etl.quotas(2_000_001, {"a": 1, "b": 1, "c": 1}).values()) == 2_000_001
    assert etl.carried({"a": 10, "b": 10, "c": 10}, {"a": 5, "b": 20}) == {"a": 10, "b": 13, "c": 12}


def test_facade_end_to_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "introduction.md").write_text("# Introduction\nWelcome to the zeppelin manual.\n## Getting Started\nFill the gas.\n")
    (folder / "python_basics.txt").write_text("Python is a language.\nIt has lists.\n")
    (folder / "config.yaml").write_text("database:\n  host: localhost\n  port: 5432\n")
    (folder / "script.py").write_text("def main():\n    print('x')\n\nif __name__ == '__main__':\n    main()\n")
    (folder / "bad.txt").write_bytes(b"caf\xff bytes zeppelin")
    (folder / "skip.bin").write_bytes(b"x")
    engine = Engine(spark, f"file://{tmp_path}/index", embedder=HashedWords(64))
    assert engine.index_status().is_indexed is False and engine.find_relevant_docs("x") == []
    done = engine.index_folder(str(folder))
    assert done.indexed_count == 5 and done.total_chunks > 5
    best = engine.find_relevant_docs("zeppelin", 2)
    assert len(best) == 2 and best[0]["source"] in {"introduction.md", "bad.txt"}
    assert engine.ask_question("zeppelin manual").sources
    assert "5 unchanged" in engine.index_folder(str(folder)).message
    (folder / "python_basics.txt").write_text("shorter")
    (folder / "script.py").unlink()
    changed = engine.index_folder(str(folder))
    assert "1 files indexed, 3 unchanged, 1 removed" in changed.message
    assert engine.index_folder(str(folder), "*.md").message.startswith("0 files indexed, 1 unchanged, 0 removed")
    assert engine.index_status().indexed_count == 4
    assert engine.index_folder(str(tmp_path / "missing")).message.startswith("Error")
    assert engine.index_status().indexed_count == 4  # a bad path leaves the index alone
    other = tmp_path / "other"
    shutil.copytree(folder, other)
    (other / "config.yaml").unlink()
    assert engine.index_folder(str(other)).indexed_count == 3 and engine.index_status().indexed_count == 3
    assert engine.find_relevant_docs("zeppelin", 0) == []


class Counting:
    """Writes a line for each text it is asked for, wherever it runs."""

    def __init__(self, path):
        self.path = path

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"{hash(t)}\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]


def test_each_new_chunk_is_embedded_once_and_postings_of_others_stay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.txt").write_text(f"lantern number {i} stands here")
    calls = tmp_path / "calls"
    engine = Engine(spark, f"file://{tmp_path}/index", embedder=Counting(str(calls)))
    assert engine.index_folder(str(folder)).total_chunks == 3
    assert len(calls.read_text().splitlines()) == 3
    (folder / "f1.txt").write_text("another text altogether, without the word")
    (folder / "f2.txt").unlink()
    assert engine.index_folder(str(folder)).total_chunks == 2
    assert len(calls.read_text().splitlines()) == 4
    meta = engine.store.meta()
    index = bm25.Index.load(spark, f"{engine.store.root}/{meta['snapshot']}")
    fresh = bm25.build_index(engine.store.table("chunks", "chunk_id string, doc_text string"), "chunk_id", "doc_text")
    for name in ("postings", "lengths", "terms", "corpus"):
        a, b = getattr(index, name), getattr(fresh, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    (best,) = [r for r in engine.find_relevant_docs("lantern", 5) if r["source"] == "f0.txt"]
    assert engine.get(best["chunk_id"])["content"].startswith("lantern") and engine.get("none") is None
    assert engine.ask_question("lantern").source_files[0] == "f0.txt"


def test_a_damaged_index_is_built_anew_and_clear_forgets(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "index"
    folder.mkdir()
    (folder / "a.txt").write_text("a quiet harbour")
    engine = Engine(spark, f"file://{root}")
    for _ in range(3):
        assert engine.index_folder(str(folder)).total_chunks == 1
    (folder / "b.txt").write_text("b")
    engine.index_folder(str(folder))
    (folder / "c.txt").write_text("c")
    engine.index_folder(str(folder))
    assert len(list(root.glob("v-*/chunks"))) == 2  # older versions go
    for f in root.glob("v-*/manifest/*.parquet"):
        f.write_bytes(b"broken")
    for f in root.glob("v-*/manifest/.*.crc"):
        f.unlink()
    done = engine.index_folder(str(folder))
    assert done.total_chunks == 3 and done.message.startswith("3 files indexed")
    engine.clear()
    assert engine.index_status().is_indexed is False and not root.exists()
    assert engine.index_folder(str(folder)).total_chunks == 3


def test_stream_of_texts(spark, tmp_path):
    rows = [(i, "word " * 200) for i in range(4)]
    source = str(tmp_path / "src")
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    for _ in range(2):  # a restart adds nothing
        start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunk_stream(batch).count()
