import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from docveil.llm import encoding as E, mixing as M
from docveil.llm.codepoints import flat, groups, ragged, strings
from docveil.llm.lexicon import Lexicon

PATH = os.path.join(E.TOKENIZERS, f"{E.VOCABULARY}.tiktoken")
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
TEXTS = ["it's we've 'll  'sam ''s \"'s don't I'd've", "<|endoftext|> x", "  a\n\n b \n", "'", "", " ", "a  ", "x'r", "x're", "'ve'", "é's1's", "　　a 　b\t c", "'S 's", "語😀 नमस्ते", "\x1c a\x85b", "١٢٣ ½²", None, "a" * 5000]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(E.TOKENIZERS, f"{E.VOCABULARY}.json"))
    t.encode_special_tokens = True
    return t


@needs
def test_ids_equal_the_reference(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, text_to_count string")
    ref = reference()
    want = {i: ref.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.ids for r in E.encode(df).collect()} == want
    assert {r.doc_id: r.n_tokens for r in E.token_counts(df, ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}
    assert E.encode(df.limit(0)).count() == 0


@needs
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" '\nabstveml1²Aé語 　.,<|>")), max_size=20), max_size=5))
def test_any_text(texts):
    encoder = E.Encoder(PATH, lexicon())
    cp, offsets = flat(pa.array(texts, pa.string()))
    ids, at = encoder(cp, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in reference_once().encode_batch(texts, add_special_tokens=False)]
    assert encoder.counts(cp, offsets).tolist() == np.diff(at).tolist()


_kept: dict = {}


def lexicon():
    return _kept.setdefault("lexicon", None) or _kept.__setitem__("lexicon", Lexicon.of(E.vocabulary_words(PATH))) or _kept["lexicon"]


def reference_once():
    return _kept.setdefault("reference", None) or _kept.__setitem__("reference", reference()) or _kept["reference"]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcd", min_size=1, max_size=6), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=30), st.lists(st.text(alphabet="abcde", max_size=7), max_size=20))
def test_lexicon(entries, words):
    lex = Lexicon.of(entries)
    every = [*entries, *words]
    cp = np.frombuffer("".join(every).encode("utf-32-le"), "<u4")
    size = np.array([len(w) for w in every], np.int64)
    number = lex.number(np.append(cp, 0).astype(np.uint32), np.cumsum(size) - size, size)
    for w, k in zip(every, number):
        assert (k >= 0) == (w in entries)
        if k >= 0:
            assert lex.ids[lex.id_offsets[k] : lex.id_offsets[k + 1]].tolist() == entries[w]


def test_lexicon_shares_suffixes_and_keeps(tmp_path):
    lex = Lexicon.of({a + "ing": [i] for i, a in enumerate("abcdef")})
    assert len(lex.final) == 5
    again = Lexicon.load(lex.save(str(tmp_path)))
    assert all((getattr(again, f) == getattr(lex, f)).all() for f in ("symbols", "moves", "target", "skip", "final", "ids"))


def test_code_points():
    a = pa.array(["é", None, "", "😀b"]).slice(0)
    cp, offsets = flat(a)
    assert offsets.tolist() == [0, 1, 1, 1, 3] and strings(cp, offsets).to_pylist() == ["é", "", "", "😀b"]
    cp, offsets = flat(pa.array(["xx", "é", "z"]).slice(1, 1))
    assert cp.tolist() == [0xE9] and offsets.tolist() == [0, 1]
    assert ragged(np.array([2, 0, 3])).tolist() == [0, 1, 0, 1, 2]
    assert list(groups(np.array([0, 5, 6, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_allocation():
    assert M.allocation({"a": 100, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 1)], 200) == {"a": 100, "b": 100}
    got = M.allocation({"a": 10, "b": 190}, [("a", 0.5, 3), ("b", 0.5, 2), ("c", 0.0, 9), ("d", 0.5, 2)], 200)
    assert got["a"] == 30 and got["b"] == pytest.approx(170) and got["c"] == got["d"] == 0
    assert sum(M.allocation({"a": 5}, [("a", 1.0, 0)], 5).values()) == 0


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(600)] + [(9000, "other", 5), (9001, None, 5), (None, "big", 5), (9002, "big", 0), (5, "big", 15)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").dropDuplicates(["doc_id"])
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    copies, report = M.mix(df, targets)
    got, rep = copies.collect(), {r.source: r for r in report.collect()}
    total = sum(r.available for r in rep.values())
    for s in ("big", "small"):
        own = [r for r in got if r.source == s]
        assert sum(r.n_tokens * r.copies for r in own) == rep[s].actual_size
        assert abs(rep[s].actual_size - rep[s].allotted) <= 8
        assert max(r.copies for r in own) <= rep[s].max_repeats and rep[s].documents == len(own)
    assert abs(sum(r.actual_size for r in rep.values()) - total) <= 16 and rep["none"].actual_size == 0
    assert rep["small"].actual_size == 2 * rep["small"].available  # short of its share, so used twice as a whole
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in M.mix(df.repartition(3), targets)[0].collect())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = M.mix(df, targets)
    assert copies.count() == 0 and report.first().actual_share == 0.0
    copies, report = M.mix(df, targets.limit(0))
    assert copies.count() == report.count() == 0


def test_mix_samples_evenly(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id < 2000, 'a', 'b') as source", "1 + id % 9 as n_tokens")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 2)], "source string, target_share double, max_repeats int")
    got = M.mix(df, targets)[0].where("source = 'a'").collect()
    sizes = np.bincount([r.n_tokens for r in got], minlength=10)[1:]
    assert sizes.min() > 70 and len(got) == pytest.approx(1000, rel=0.1)


def test_pieces_of_one_hash_stay_apart(monkeypatch):
    import numpy as np

    from docveil.llm import encoding as E

    cp = np.array([ord(c) for c in "ab cd ab xyz"], np.uint32)
    starts, sizes = np.array([0, 2, 5, 8]), np.array([2, 3, 3, 4])
    monkeypatch.setattr(E.WindowHash, "at", lambda self, start, width: np.zeros(len(start), np.uint64))
    first, back = E.equal_pieces(cp, starts, sizes)
    text = lambda k: "".join(map(chr, cp[starts[k] : starts[k] + sizes[k]]))
    assert [text(first[b]) for b in back] == [text(k) for k in range(4)]
