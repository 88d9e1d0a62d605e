"""What a Python worker holds: bounded work of a task, nothing left behind."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import language_id, near_dedup, token_output
from corvane.llm.queries import byte_bpe
from corvane.llm.token_output import Encoder
from tests.llm import brute


def test_texts_compared_with_a_centre_are_bounded_by_their_size(spark, tmp_path, monkeypatch):
    verify = near_dedup._verify

    def noted(percent, k):
        run = verify(percent, k)

        def both(batches):
            import uuid

            kept = list(batches)
            words = defaultdict(list)
            for b in kept:
                for g, side, _, t in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    words[g].append(len(t.split()) * side)
            (tmp_path / uuid.uuid4().hex).write_text(" ".join(str(sum(v)) for v in words.values()))
            return run(iter(kept))

        return both

    monkeypatch.setattr(near_dedup, "_verify", noted)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(60)]  # one star: a centre and 59 others of 301 words
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=3000)
    assert Counter(map(tuple, out.collect())) == Counter(brute.near(rows))
    sizes = [int(x) for f in tmp_path.iterdir() for x in f.read_text().split()]
    assert max(sizes) <= 3 * 3000  # dealt by hash: six groups of 2,960 words on average; it was one of 17,759


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_slices_hold_every_row_once(limit):
    from corvane.llm.common import slices

    texts = ["x" * n for n in (0, 10, 100, 0, 49, 1, 0)] + [None, "é" * 30, None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    for batch in (whole, whole.slice(2, 6), whole.slice(0, 0)):
        parts = list(slices(batch, 1, limit))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= limit for p in parts)


def test_words_of_one_text_at_a_time():
    import tracemalloc

    docs = [b" ".join(b"word%d" % (i % 97) for i in range(2000))] * 150
    tracemalloc.start()
    sets = near_dedup.exact_sets(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(s) == 97 for s in sets)
    assert peak < 100 * 2000 * 150  # 89 bytes a word; 136 when all texts' words were objects at once


def test_encoder_forgets_words_that_come_once():
    e = Encoder(byte_bpe())
    texts = [" ".join(f"w{i}x{j} the" for j in range(10)) for i in range(500)]
    assert e.encode(texts) == [np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(len(v) for v in vars(e).values() if isinstance(v, dict)) < 1000  # it held all 5,000 words


@pytest.mark.parametrize("group", [1, 40, 1 << 20])
@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_encoder_takes_columns_in_groups(monkeypatch, group, limit):
    monkeypatch.setattr(token_output, "GROUP", group)
    e, r = Encoder(byte_bpe(), limit), random.Random(7)
    signs = ["a", "b", "é", "ß", "ŋ", "Ж", "語", "ʰ", ".", ",", "!?", "'", "'s", "7", "\x00", "\x7f", "$$$", " ", " ", "\n", "  ", "\t", "\x85", "\xa0"]
    signs += ["\u2003", "\u2028", "\u2019", "\u202f", "\u3000", "\x1c", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, [9] * 17 + [30, 30, 9] + [1] * 11, k=r.randint(0, 25))) for _ in range(1500)] + [None, "", "\n", " ", "a\n", " a", "the. the. the\nthe. the", "ʰ. Ж, ʰ!"]
    expected = [np.array(e.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(e.encode_column(pa.array(texts))) == expected
    assert list(e.encode_column(pa.array(texts).slice(700, 805))) == expected[700:1505]
    assert list(e.encode_column(pa.array([], pa.string()))) == [] and e.encode(["", ""]) == [b"", b""]
    assert len(e.known) <= limit


def test_encoder_frees_the_cut_before_it_encodes(monkeypatch):
    import tracemalloc

    e, held = Encoder(byte_bpe()), []
    parts = e._parts

    def noted(*args):
        held.append(tracemalloc.get_traced_memory()[0])
        return parts(*args)

    monkeypatch.setattr(e, "_parts", noted)
    text = "a bc d " * 400_000 + "end"
    column = pa.array([text])
    tracemalloc.start()
    (ids,) = e.encode_column(column)
    tracemalloc.stop()
    assert ids == np.array(e.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(held) == 1 and held[0] < len(text)  # masks and places of separators were held: five times the text


def test_languages_are_found_a_slice_at_a_time():
    class Shared:
        value = language_id.Model(["x", "y"], np.random.default_rng(3).random((256, 2), np.float32), np.zeros(2))

    texts = [f"{i} " + "ab cd" * 200_000 for i in range(12)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(14)), pa.array(texts)], ["doc_id", "text"])
    out = list(language_id._predict(Shared, (1,), ("l", "s"))(iter([batch])))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(14))
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()) <= 4 << 20 for b in out)  # all 12 MB came as one batch
    label, score = Shared.value.predict(texts, (1,))
    assert [x for b in out for x in b.column(2).to_pylist()] == label
    assert [x for b in out for x in b.column(3).to_pylist()] == score


def test_plain_words_are_merged_without_the_library():
    class Refuses:
        def __getattr__(self, name):
            raise AssertionError("the library was asked")

    r = random.Random(11)
    letters = "etaonihrsdlu" * 5 + "ETAÀÖØßéöøÿĀŋƀƻǀǅɎɏЀаяѿ"
    signs = ["0", "1907", ".", "!!", "...", ",", "$", "_", "-", "(", "\"", "#~", "the", "ing", "aaaa"]
    words = ["".join(r.choice(signs) if r.random() < 0.15 else r.choice(letters) for _ in range(r.randint(1, 24))) for _ in range(20_000)]
    texts = [r.choice(" \n").join(words[i : i + 40]) for i in range(0, len(words), 40)] + ["a" * 63, "a " + "é" * 31, ""]
    texts += [f"{c} a{c}b .{c}1 {c}{c}?" for c in map(chr, [*range(0xC0, 0x250), *range(0x400, 0x480)]) if c not in "×÷"]
    e = Encoder(byte_bpe())
    expected = [np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    e.whole = e.bpe = Refuses()
    assert e.encode(texts) == expected
    assert set(e.known) <= {"\n"}


def test_words_whose_bytes_do_not_tell_go_through_the_library():
    e = Encoder(byte_bpe())
    beside = ["'s", "don't", "!'s", "×", "a×b", "3÷4", "ɐ", "aɐɏ", "µm", "x²", "½", "Ω", "ҁ", "а҂", "語x", "\x00", "a\x7f", "x" * 64, "x" * 65, "é" * 40, "12" * 40, ".," * 50, "ʰ", "é́"]
    texts = [f"{x} a{x}, b{y}{x}. {x}1\n{y} the" for x in beside for y in beside]
    expected = [np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == expected
    e.merges = None  # as with a model that does more than merge
    e.known.clear()
    assert e.encode(texts) == expected


def test_merges_are_refused_where_the_model_does_more():
    import json

    from tokenizers import Tokenizer

    from corvane.llm.merges import Merges

    e = Encoder(byte_bpe())
    alphabet = list(map(chr, e.behind))
    alphabet[10] = e.line_sign
    j = json.loads(e.whole.to_str())
    assert Merges.of(e.whole, alphabet) is not None
    for key, value in (("ignore_merges", True), ("dropout", 0.5), ("end_of_word_suffix", "!")):
        assert Merges.of(Tokenizer.from_str(json.dumps(j | {"model": j["model"] | {key: value}})), alphabet) is None
