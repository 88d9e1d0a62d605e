"""Chunkers: native windows against the plain loop, and structure-aware splitters."""

import random

import pytest

from corvane.config import Settings
from corvane.operators.structured import chunk_files, html_text, split_text, windows
from corvane.operators.windows import paragraph_chunks, window_chunks


def sample():
    r = random.Random(4)
    texts = ["", "hello", "a " * 500, "word " * 1500, "x" * 1200, "a\n\nb " * 300, None]
    texts += ["".join(r.choice(["ab ", "c", "\n\n", "é", " ", "longer"]) for _ in range(r.randint(0, 900))) for _ in range(60)]
    return texts


@pytest.mark.parametrize(("native", "paragraphs"), [(window_chunks, False), (paragraph_chunks, True)])
def test_native_windows_equal_the_loop(spark, native, paragraphs):
    texts = sample()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in native(df).collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["position_start"], r["position_end"], r["content"]))
    for i, t in enumerate(texts):
        expected = [(k, a, b, t[a:b]) for k, (a, b) in enumerate(windows(t or "", 500, 50, paragraphs))]
        assert sorted(got.get(i, [])) == expected


def test_gapless_windows_cover_the_text(spark):
    df = spark.createDataFrame([("y" * 20 + " " + "x" * 900,)], "text string")
    rows = window_chunks(df, gapless=True).orderBy("chunk_index").collect()
    assert all(a["position_end"] >= b["position_start"] for a, b in zip(rows, rows[1:], strict=False))


def labels(text, ext, key):
    return [p.labels.get(key) for p in split_text(text, ext)]


def test_json():
    assert split_text("", "json") == [] and split_text("{}", "json") == [] and split_text("3", "json") == []
    assert labels('{"planet": "Mars", "moons": 2}', ".json", "key_path") == ["planet", "moons"]
    assert labels('{"mass": 6.4, "ring": false, "orbit": 687, "life": null}', "json", "value_type") == ["float", "boolean", "integer", "null"]
    assert labels('{"moons": [{"km": 22}, {"km": 12}]}', "json", "key_path") == ["moons.0.km", "moons.1.km"]
    assert labels('["Io", null, 7, {"ice": false}]', "json", "key_path") == ["0", "1", "2", "3.ice"]
    assert labels('{"sun": {"earth": {"moon": "grey"}}}', "json", "key_path") == ["sun.earth.moon"]
    (p,) = split_text('{"k": "v, {x}"}', "json")
    assert p.text == '"v, {x}"' and '{"k": "v, {x}"}'[p.start : p.end] == p.text


def test_yaml():
    text = "ship:\n  mast: oak\n  sails: 3\nport:\n  mast: none\n"
    assert labels(text, "yml", "key_path") == ["ship", "ship.mast", "ship.sails", "port", "port.mast"]
    kinds = "sails: 3\nmast: oak\nafloat: yes\nspeed: 7.25\nflag: ~\ncode: '07'\ncrew: [ann]\nhold:\n"
    assert labels(kinds, "yaml", "value_type") == ["integer", "string", "boolean", "float", "null", "string", "sequence"]
    assert split_text("- a\n- b\n", "yaml") == [] and split_text("a: [", "yaml") == []
    assert labels("- 5\n- mast: oak\n  sails: 3\n- mast: fir\n", "yaml", "key_path") == ["mast", "sails"]  # a list is read by its first mapping


def test_markdown():
    assert split_text("", "md") == [] and len(split_text("plain words", "md")) == 1
    text = "before\n\n# Tea\nleaves\n\n~~~\n# still code\n~~~\n### Green\nmild\n# Coffee\n"
    pieces = split_text(text, "md")
    assert [p.labels.get("section") for p in pieces] == [None, "# Tea", "### Green", "# Coffee"]
    assert "still code" in pieces[1].text and "mild" in pieces[1].text  # nested sections are repeated
    assert text[pieces[2].start : pieces[2].end].startswith("### Green")
    long = split_text("# Tea\n" + "<li>steep it for a while</li>" * 50, "md", 500, 50)
    assert len(long) > 1 and all("steep it" in p.text for p in long)
    assert html_text("<ul><li>one</li><li>zwölf</li></ul><b class='x'>end</b>").split() == ["one", "zwölf", "end"]


def test_markdown_underlined_headings():
    text = "Tea\n===\nleaves\n\nGreen\ntea\n---\nmild\n\n---\n- item\n---\n"
    pieces = split_text(text, "md")
    assert [p.labels.get("section") for p in pieces] == ["Tea", "Green\ntea"]  # a line behind a blank one or a list is a rule
    assert "mild" in pieces[0].text and text[pieces[1].start :].startswith("Green\ntea\n---\nmild")


def test_code():
    py = "import re\n\ndef brew(t):\n    'heiß'\n    return t\n\n@hot\nclass Kettle:\n    def pour(self): pass\n\nif re:\n    async def wait(): pass\n"
    assert labels(py, "py", "function_name") == ["brew", "", "wait"] and labels(py, "py", "class_name")[1] == "Kettle"
    assert split_text(py, "py")[0].text == "def brew(t):\n    'heiß'\n    return t"
    assert split_text(py, "py")[0].labels["line_start"] == "3"
    assert len(split_text("x = 1\ny = 2\n", "py")) == 1 and len(split_text("def broken(:\n", "py")) == 1
    ts = "interface Leaf { name: string }\nfunction steep(min: number): string { return `for ${min}`; }\nclass Pot {\n  lid = 1;\n  constructor() {}\n  fill(): void { if (hot) { stir(); } }\n}\nconst twice = (n: number) => n * 2;\nconst cups = 5;\n"
    got = [(p.labels["function_name"], p.labels["class_name"]) for p in split_text(ts, "ts")]
    assert got == [("steep", ""), ("constructor", "Pot"), ("fill", "Pot"), ("twice", "")]
    js = "// function none() {}\nasync function cool() { return '}' }\nconst heat = async () => { x() };\nclass Cup { sip() { return 1 } }\n"
    assert [(p.labels["function_name"], p.labels["class_name"]) for p in split_text(js, "js")] == [("cool", ""), ("", ""), ("sip", "")]


def test_units_of_python_that_does_not_parse():
    py = "x = (\n\ndef brew(t):\n    # hot\n    if t\n\n        return t\n\nclass Kettle(\n    Pot,\n):\n    lid = 1\nprint x\nasync def wait():\n    pass\n"
    got = [(p.labels["function_name"], p.labels["class_name"], p.text.splitlines()[-1].strip()) for p in split_text(py, "py")]
    assert got == [("brew", "", "return t"), ("", "Kettle", "lid = 1"), ("wait", "", "pass")]


def test_chunk_files(spark):
    df = spark.createDataFrame([("a.md", ".md", "# T\nx"), ("b.txt", ".txt", "word " * 300), ("c.json", ".json", None)], "rel string, ext string, text string")
    out = chunk_files(df, Settings(chunk_configs={"txt": (100, 10)})).collect()
    assert {r["rel"] for r in out} == {"a.md", "b.txt"}
    assert max(len(r["content"]) for r in out if r["rel"] == "b.txt") <= 100
    assert next(r for r in out if r["rel"] == "a.md")["metadata"] == {"section": "# T"}
