"""Benchmark passages are cut out of documents that stay."""

from corvane.llm.contamination import cut_documents
from tests.llm import brute

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
FILL = " ".join(f"w{i}" for i in range(400))


def test_kept_documents_hold_no_benchmark_window(spark):
    w = ITEM.split()
    texts = {
        1: f"{FILL}, ALPHA-beta {' '.join(w[2:])}! Zwölf, the end. ",
        2: f"{FILL} {FILL} {' '.join(w[:6])} {ITEM}; {' '.join(w[6:])} tail",  # the cut brings the words together anew
        3: f"{ITEM} few words",
        4: FILL + " clean\n",
        5: None,
        6: "",
        7: f"{ITEM}\n{FILL} z",
    }
    rows = [(i, t, None if t is None else len(t)) for i, t in texts.items()] + [(1, texts[1], len(texts[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = cut_documents(docs, spark.createDataFrame([(0, ITEM)], "item_id long, text string"))
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.where("text IS NOT NULL").collect())
    expected = {1: FILL + "! Zwölf, the end. ", 2: f"{FILL} {FILL} tail", 4: texts[4], 6: "", 7: f"\n{FILL} z"}
    assert got == sorted((i, expected[i], len(expected[i])) for i in (1, 1, 2, 4, 6, 7))
    assert out.where("text IS NULL").count() == 1 and out.columns == docs.columns
    assert not any(x[2] for x in brute.contamination([(i, t) for i, t, _ in got], [(0, ITEM)]))
