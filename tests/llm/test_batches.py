"""What a worker is sent, and which workers there are."""

import pyarrow as pa

from corvane.llm import common, mixing
from corvane.operators.workers import BATCH, map_batches


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    out = map_batches(spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 20000) AS text"), sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in out) == 2000 and max(r["bytes"] for r in out) <= BATCH + 50_000


def test_powers_are_not_kept_between_tasks():
    common._powers(10)
    common.release()
    assert common._pow == [] and len(common._powers(10)) == 2


def test_the_mix_starts_no_python_worker(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words", "s%d" % (i % 3)) for i in range(60)], "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars")
    docs.write.mode("overwrite").format("noop").save()
    out = mixing.mix_sources(docs, weights=(1, 2, 3), limit=3)
    plan = out._jdf.queryExecution().toString()
    assert out.count() >= 60 and plan.count("Scan ExistingRDD") <= 1  # that of the test's own rows
