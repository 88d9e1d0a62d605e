"""Column functions against literal expectations and plain Python."""

import re
import string

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stopwords import stop_words


def values(spark, column, *inputs, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def plain_tokens(t):
    out = []
    for w in t.lower().split():
        out.append(w)
        if re.fullmatch(r"[a-z]+-[0-9]+([-–][0-9]+)*", w):
            out.append(re.sub("[-–]", "", w))
    stops = set(stop_words())
    return [w for w in " ".join(out).translate(str.maketrans("", "", string.punctuation)).split() if w not in stops]


def test_tokens(spark):
    texts = ["Hello, WORLD!", "the quick brown fox", "", "SCP-002 and SCP-002?", "MTF-Echo-11 scp-1-2–3", "don't it's", "a b\tc\nd", "Привет и мир"]
    assert values(spark, T.tokens("x"), *texts) == [plain_tokens(t) for t in texts]
    assert values(spark, T.tokens("x"), None) == [None]
    assert plain_tokens("SCP-002") == ["scp002", "scp002"]


def test_names(spark):
    names = ["scp_SCP-003.md", "mtf-alpha.txt", "Site19.json", "notes.md", "scp-5.tar.md", ".hidden", "noext"]
    assert values(spark, T.entity_id("x"), *names) == ["SCP-003", "alpha", "19", None, "5.tar", None, None]
    assert values(spark, T.stem("x"), *names)[-3:] == ["scp-5.tar", ".hidden", "noext"]
    assert values(spark, T.extension("x"), *names)[-3:] == [".md", "", ""]
    assert values(spark, T.base_name("x"), "a/b/c.md", "c", "a/") == ["c.md", "c", ""]


@pytest.mark.parametrize(("pattern", "fits"), [("*", [1, 1, 1]), ("*.md", [1, 0, 0]), ("[!a]*", [0, 1, 1]), ("{a,b}*", [0, 0, 1]), ("?.txt", [0, 1, 0])])
def test_glob(spark, pattern, fits):
    assert values(spark, T.glob_match("x", pattern), "a.md", "b.txt", "{a,b}.py") == [bool(f) for f in fits]


def test_markup_and_file_names(spark):
    html = "<p>One &amp; <b>two</b></p><script>x()</script><!-- no -->\n<div>three<br/>four</div><a href='x'>link</a>"
    assert values(spark, T.strip_html("x"), html) == ["\nOne & two\nthree\nfour\nlink"]
    assert values(spark, T.file_name("x"), 'a<b>: "c"/d', "...", "", "x" * 99) == ["a_b__ _c__d".replace(" ", "_"), "untitled", "untitled", "x" * 80]
    assert values(spark, T.content_name("x"), "/a/b.json", "./../c/d", "e") == ["b.json", "c/d", "e"]


def test_grades(spark):
    replies = ["relevant: yes\nscore: 0.9", "relevant: no\nscore: 0.0", "unsure", "relevant: no\nscore: 0.3", "score: high", "relevant: no\nrelevant: yes", " relevant: no"]
    got = [(r["relevant"], r["score"]) for r in values(spark, T.parse_grade("x"), *replies)]
    assert got == [(True, 0.9), (False, 0.0), (True, 0.0), (True, 0.3), (True, 0.0), (True, 0.0), (True, 0.0)]


def test_scalar_types(spark):
    plain = ["1", "-2_000", "2.5", "1e3", "nan", "yes", "True", "~", "", "x", None]
    assert values(spark, T.yaml_type("x"), *plain) == ["integer", "integer", "float", "float", "float", "boolean", "string", "null", "null", "string", "null"]
    raw = ['"a"', "1", "1.5", "1e3", "true", "null", "x"]
    assert values(spark, T.json_type("x"), *raw) == ["string", "integer", "float", "float", "boolean", "null", "unknown"]


def test_hints_keys_prompts(spark):
    df = spark.createDataFrame([(0, 30, "s", "c" * 300), (None, 5, "s", "c")], "a long, b long, s string, c string")
    got = df.select(T.position_hint("a", "b"), T.dedup_key("s", "c"), T.render("<{q}|{q}>{r}", q="s", r="c")).collect()
    assert got[0][0] == "[chars 0-30]" and got[1][0] == ""
    assert got[0][1] == "s::" + "c" * 200 and got[1][2] == "<s|s>c"
    chosen = spark.createDataFrame([(" ", None, " q "), ("b ", "r", "q"), (None, "r", "q")], "b string, r string, q string")
    assert [r[0] for r in chosen.select(T.chosen_query("b", "r", "q")).collect()] == ["q", "b", "r"]
    assert df.select(F.count("*")).first()[0] == 2
