import random

import pytest

from docveil.operators import layout

BOX = "struct<x:double,y:double,width:double,height:double>"
LETTERS = f"doc string, page_no int, seq int, value string, bbox {BOX}, font_size double, baseline_y double, src struct<op_index:int,array_item:int,byte_start:int,byte_len:int>, extra int"


def letter(seq, value, x, b=100.0, size=10.0, width=5.0, doc="d", page=1):
    return (doc, page, seq, value, (float(x), b - 2, width, 9.0), size, float(b), (1, None, seq, 1), 0)


def words(spark, rows, second=True):
    df = spark.createDataFrame(rows, LETTERS)
    out = layout.second_pass(df) if second else layout.first_words(layout.first_pass(df))
    return [r.text for r in out.orderBy("doc", "page_no", "word_no" if second else "word1").collect()]


@pytest.mark.parametrize("x,joined", [(3.0, True), (2.99, False), (7.99, True), (8.0, False)])
def test_gap(spark, x, joined):
    assert words(spark, [letter(0, "a", 0), letter(1, "b", x)]) == (["ab"] if joined else ["a", "b"] if x > 0 else ["b", "a"])


@pytest.mark.parametrize("b,joined", [(98.01, True), (98.0, False)])
def test_baseline(spark, b, joined):
    assert words(spark, [letter(0, "a", 0), letter(1, "b", 5, b)]) == (["ab"] if joined else ["a", "b"])


def test_blanks_nulls_and_duplicates(spark):
    rows = [letter(0, "a", 0), letter(0, "a", 0), letter(1, " ", 5), letter(2, " ", 5), letter(3, None, 5), letter(4, "b", 5), letter(5, "c", 5, doc="e"), letter(6, "d", 10, page=2)]
    assert words(spark, rows) == ["ab", "d", "c"]
    assert words(spark, [letter(1, " ", 5)]) == [] and words(spark, []) == []


def loop_words(letters, pass_two):
    """The reading of the rule as a loop."""
    out, current = [], []
    for x in letters:
        if current:
            last = current[-1]
            gap = x[4][0] - (last[4][0] + last[4][2])
            if abs(x[6] - last[6]) < last[5] * 0.2 and -2.0 <= gap < last[5] * 0.3:
                current.append(x)
                continue
            out.append(current)
        current = [x]
    return out + ([current] if current else [])


def loop_page(letters):
    one = loop_words(sorted(letters, key=lambda x: -x[6]), False)
    one = [sorted(w, key=lambda x: x[4][0]) for w in one]
    one.sort(key=lambda w: (-w[0][6], min(x[4][0] for x in w)))
    return one, loop_words(sorted((x for w in one for x in w), key=lambda x: (-x[6], x[4][0])), True)


def test_words_equal_the_loop(spark):
    rng = random.Random(3)
    rows, want, fonts = [], {}, {}
    for page in range(1, 41):
        own = [letter(i, rng.choice("abcdef"), rng.choice([0, 3, 5, 8, 10, 15, 20, 30]), rng.choice([100.0, 99.0, 98.0, 80.0]), rng.choice([8.0, 10.0, 20.0]), page=page) for i in range(rng.randint(1, 14))]
        rows += own
        one, two = loop_page(own)
        want[page] = ["".join(x[3] for x in w) for w in two]
        fonts[page] = [w[0][5] for w in one]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LETTERS)
    got: dict = {}
    for r in layout.second_pass(df).orderBy("page_no", "word_no").collect():
        got.setdefault(r.page_no, []).append(r.text)
    assert got == want
    every = [f for own in fonts.values() for f in own]
    assert layout.global_font(df).first().mean_font == pytest.approx(sum(every) / len(every))


def word(no, x, b, width=10.0, size=10.0, height=10.0):
    return {"word_no": no, "x": float(x), "y": b - 2.0, "width": width, "height": height, "font_size": size, "baseline_y": float(b)}


def blocks(*words):
    return {r["word_no"]: (r["block_no"], r["line_no"], r["pos"]) for r in layout.group_page(list(words))}


def test_lines():
    assert blocks(word(0, 0, 100), word(1, 37.9, 100)) == {0: (0, 0, 0), 1: (0, 0, 1)}
    assert blocks(word(0, 0, 100), word(1, 38, 100))[1][0] == 1  # a gap of 2.8 sizes splits
    assert blocks(word(0, 0, 100), word(1, 12, 96.1))[1] == (0, 0, 1)
    assert blocks(word(0, 0, 100), word(1, 12, 96))[1] == (1, 0, 0)  # 0.4 sizes lower is another line, which overlaps no block


def test_blocks_and_columns():
    assert blocks(word(0, 0, 100), word(1, 0, 82.1)) == {0: (0, 0, 0), 1: (0, 1, 0)}
    assert blocks(word(0, 0, 100), word(1, 0, 82))[1] == (1, 0, 0)
    assert blocks(word(0, 0, 100), word(1, 10, 90))[1][0] == 1  # ranges that touch don't overlap
    assert blocks(word(0, 300, 200), word(1, 0, 100), word(2, 300, 60)) == {1: (0, 0, 0), 0: (1, 0, 0), 2: (2, 0, 0)}
    assert blocks(word(0, 50, 200), word(1, 0, 100)) == {0: (0, 0, 0), 1: (1, 0, 0)}  # 50 apart is one column


def test_segmented(spark):
    rows = [("d", i, t, h) for i, (t, h) in enumerate([("Titre", True), ("un", False), ("deux.", False), ("trois ?", False), ("quatre :", False), ("cinq", False), ("Titre", True), ("six!", False), ("sept", False)])]
    got = layout.segmented(spark.createDataFrame(rows, "doc string, block_ord int, text string, is_heading boolean"))
    assert [r.para_no for r in got.orderBy("block_ord").collect()] == [0, 1, 1, 2, 2, 3, 4, 5, 6]


def test_ranges(spark):
    rows = [("d", 0, 0, "Léa"), ("d", 0, 1, "😀"), ("d", 0, 2, "x"), ("d", 1, 0, "y")]
    got = layout.ranges(spark.createDataFrame(rows, "doc string, para_no int, word_no int, text string"), ["doc", "para_no"], ["word_no"])
    assert sorted((r.para_no, r.start_pos, r.end_pos) for r in got.collect()) == [(0, 0, 3), (0, 4, 5), (0, 6, 7), (1, 0, 1)]


def test_paragraphs(spark):
    rows, seq = [], 0
    for page, b, size, text in ((1, 700.0, 30.0, "Titre"), (1, 600.0, 10.0, "un deux"), (1, 589.0, 10.0, "trois"), (2, 700.0, 10.0, "quatre.")):
        x = 0.0
        for c in text:
            rows.append(letter(seq, c, x, b, size, size / 2, page=page))
            x += size / 2
            seq += 1
    w, p = layout.paragraphs(spark.createDataFrame(rows, LETTERS))
    got = {r.para_no: (r.text, r.is_heading, r.page_no) for r in p.collect()}
    assert got == {0: ("Titre", True, 1), 1: ("un deux trois quatre.", False, 1)}
    for r in w.collect():
        assert got[r.para_no][0][r.start_pos : r.end_pos] == r.text
    w, p = layout.paragraphs(spark.createDataFrame([], LETTERS))
    assert w.count() == p.count() == 0
