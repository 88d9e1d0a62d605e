"""The grader sees text, not markup."""

from corvane.plans.loop import StubModel, grade


class Strict:
    def __call__(self, prompt):
        return f"relevant: {'no' if '<' in prompt or 'span' in prompt else 'yes'}\nscore: 0"


def test_markup_is_turned_into_text(spark):
    rows = [("a", "<p><span></span></p>\n<!-- span -->"), ("b", "<span>hello</span> world"), ("c", "plain")]
    chunks = spark.createDataFrame(rows, "source string, content string")
    got = {r["source"]: (r["content"], r["relevant"]) for r in grade(chunks, "q", Strict()).collect()}
    assert got == {"a": (rows[0][1], False), "b": (rows[1][1], True), "c": ("plain", True)}
    assert {r["source"]: r["relevant"] for r in grade(chunks, "span class", StubModel()).collect()} == {"a": False, "b": False, "c": False}
