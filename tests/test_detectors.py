import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from docveil.functions import patterns
from docveil.functions import text as T
from docveil.operators import markdown, redaction

# The five patterns as they are defined; the engine's own forms must find the same.
NAME = regex.compile(
    r"(?m)^(?:#+\s*)?[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+(?:[-'][A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+)?[ \t  ]+(?:[A-ZÀ-ÖØ-Ý]{3,}(?:[-'’][A-ZÀ-ÖØ-Ý]{2,})*|(?:[A-ZÀ-ÖØ-Ý][ \t  ]+){2,}[A-ZÀ-ÖØ-Ý])\b"
)
BRUTE = {
    "EMAIL": regex.compile(r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "PHONE": regex.compile(r"(?:(?:\+|00)33|0)\s*[1-9](?:[\s.-]*\d+)+\b"),
    "DATE": regex.compile(r"\b\d{2}[/-]\d{2}[/-]\d{4}\b"),
    "URL": regex.compile(r"(?i)((https?:)?//)?(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)"),
}
CASES = [
    "x@y.com,", "mail: a.b+c@d-e.example.org.", "éa@b.com", "a@b", "+33 6 12 34 56 78", "0033612345678", "06.12.34.56.78", "06 12 34 56 78", "12 34", "01/02/2024 01-02/2024 1/2/2024",
    "é01/02/2024", "٠١/٠٢/٢٠٢٤", "http://a.fr/x www.a.fr 10.0.0.1 3.14 mot.Mot", "Jean DUPONT est là", "il y a Jean DUPONT", "# Jean DUPONT", "##\tAnne-Marie D'ARC-LE", "Jean Dupont", "Anne-Marie LE",
    "Jean D U P", "Jean DUPONT-MARTIN\nÉlodie ÇA Ü\nZoé ÀÉÎ", "abc\rJean DUPONT", "", "   ", "😀 a@b.com 😀 01/02/2024", "a@b.com" * 3, "// x //a.b/c?d=e", None,
]


def brute(text):
    if text is None or not text.strip():
        return []
    out = []
    for m in NAME.finditer(text):
        s, e = m.span()
        while s < e and (text[s] == "#" or text[s].isspace()):
            s += 1
        out.append((s, 0, e, "NOM_PERSONNE"))
    for k, (label, p) in enumerate(BRUTE.items(), 1):
        out += [(m.start(), k, m.end(), label) for m in p.finditer(text)]
    return [(s, e, label) for s, _, e, label in sorted(out)]


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", patterns.all_spans(F.col("text")).alias("s")).collect()
    return {r.id: None if r.s is None else [(x.start_pos, x.end_pos, x.label) for x in r.s] for r in rows}


def test_all_spans_match_brute_force(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "@", ".", "0", "6", "1", " ", " ", "/", "-", "é", "+33", "A", "É", "#", "\n", "www.", "com", "😀", "٣", "12/03/2020", "Jean", "DUP"]
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else brute(t)), repr(t)


def test_long_inputs_end(spark):
    texts = ["01" + " 2" * 5000, "5" * 20000, "Jean" + " A" * 5000, "Jean DUP" + "-AB" * 5000, "a" * 100_000, "a." * 20_000, "@" * 5000]
    got = found(spark, texts)
    assert [got[i] for i in (2, 3)] == [[(0, len(texts[i]), "NOM_PERSONNE")] for i in (2, 3)]  # however many parts
    assert len(got) == len(texts)


def test_running_sums(spark):
    from docveil.functions.arrays import running

    rng = random.Random(4)
    rows = [[], [3], [None, 2, None], *([rng.randint(0, 9) for _ in range(n)] for n in (63, 64, 65, 128, 1000))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<int>")
    got = {r.id: r.s for r in df.select("id", running(F.col("v")).alias("s")).collect()}
    for i, r in enumerate(rows):
        sums = [sum(x or 0 for x in r[:k]) for k in range(len(r))]
        assert got[i] == sums


def test_safe_phone_equals_original():
    rng = random.Random(6)
    safe = regex.compile(patterns.PHONE)
    for _ in range(20_000):
        t = "".join(rng.choice("0123 .-+a ") for _ in range(rng.randint(2, 14)))
        assert [m.span() for m in safe.finditer(t)] == [m.span() for m in BRUTE["PHONE"].finditer(t)], repr(t)


def one(spark, **columns):
    df = spark.range(1).select(*[c.alias(k) for k, c in columns.items()])
    return df.first()


def test_expressions(spark):
    lit = F.lit
    r = one(
        spark, a=T.masked_word(lit("Léa")), b=T.masked_word(lit("")), c=T.masked_word(lit(None).cast("string")), e=T.bio_tag(lit("B-PER-X")), g=T.bio_tag(lit("PER")), k=T.output_path(lit("/a.b/c.x.pdf")), l=T.stem(lit("/a.b/c.x.pdf")),
        o=T.overlaps(lit(0), lit(2), lit(2), lit(3)),
    )
    assert (r.a, r.b, r.c, r.e, r.g, r.k, r.l, r.o) == ("███", "█", None, "PER-X", "PER", "/a.b/c.x.anon.pdf", "c.x", False)


BOX = "struct<x:double,y:double,width:double,height:double>"
WORDS = f"doc string, page_no int, word_no int, text string, bbox {BOX}, para_no int, start_pos int, end_pos int, extra int"


def test_targets(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    words = spark.createDataFrame(
        [("a", 1, 0, "Jean", box, 0, 0, 4, 1), ("a", 1, 1, "x@y.z,", (2.0, 0.0, 1.0, 1.0), 0, 5, 11, 1), ("a", 1, 2, "no", (4.0, 0.0, 1.0, 1.0), 0, 12, 14, 1), ("a", 1, 3, "loose", box, None, None, None, 1),
         ("a", 1, 4, "Jean", box, 1, 0, 4, 1), ("b", 1, 0, "twin", box, 0, 0, 4, 1), ("b", 1, 1, "twin", box, 0, 0, 4, 1)],
        WORDS,
    )
    spans = "doc string, para_no int, start_pos int, end_pos int"
    ner = spark.createDataFrame([("a", 0, 0, 4), ("a", 0, 3, 5), ("a", None, 0, 99)], spans)
    rex = spark.createDataFrame([("a", 1, 1, 2), ("a", 0, 4, 6), ("a", 0, 14, 14), ("b", 0, 0, 2), (None, 0, 0, 9)], spans)
    got = sorted((r.doc, r.word_no, r.text, r.engine) for r in redaction.targets(words, ner, rex, ["doc", "para_no"]).collect())
    # the second Jean has the same page, place and text as one of ner; of the twins one is left
    assert [g[:1] + g[2:] for g in got] == [("a", "Jean", "ner"), ("a", "x@y.z,", "regex"), ("b", "twin", "regex")]
    assert {(r.doc, r.engine): r.n_words for r in redaction.counts(redaction.targets(words, ner, rex, ["doc", "para_no"])).collect()} == {("a", "ner"): 1, ("a", "regex"): 1, ("b", "regex"): 1}
    empty = words.limit(0)
    assert redaction.targets(empty, ner, rex, ["doc", "para_no"]).count() == 0


def test_markdown(spark):
    p = spark.createDataFrame(
        [("d", 0, 1, True, "Titre"), ("d", 1, 1, False, " corps "), ("d", 2, 2, False, "  "), ("d", 3, 2, None, "fin"), ("d", 4, None, False, "sans page"), ("e", 0, 5, False, None)], "doc string, para_no int, page_no int, is_heading boolean, rendered string"
    )
    got = {r.doc: r.markdown for r in markdown.export(p).collect()}
    head = "# {} (anonymisé)\n\n" + markdown.NOTICE + "\n\n---\n\n"
    assert got["d"] == head.format("d") + "*Page 1*\n\n## Titre\n\ncorps\n\n\n---\n\n*Page 2*\n\nfin\n\nsans page\n\n"
    assert got["e"] == head.format("e") + "*Page 5*\n\n"
    names = spark.createDataFrame([("d", "nom")], "doc string, name string")
    assert {r.doc: r.markdown[:6] for r in markdown.export(p, names).collect()} == {"d": "# nom ", "e": "# e (a"}


def test_rendered(spark):
    w = spark.createDataFrame([("d", 0, 1, "b,"), ("d", 0, 0, "a"), ("d", 0, 2, None), ("d", 1, 0, "c")], "doc string, para_no int, word_no int, text string")
    m = spark.createDataFrame([("d", 0, 1), ("d", 0, 1)], "doc string, para_no int, word_no int")
    got = {r.para_no: (r.rendered, r.n_masked) for r in markdown.rendered(w, m, ["doc", "para_no", "word_no"], ["doc", "para_no"], ["word_no"]).collect()}
    assert got == {0: ("a ██", 1), 1: ("c", 0)}


@pytest.mark.parametrize("pattern", list(patterns.DETECTORS.values()))
def test_no_pattern_matches_nothing(pattern):
    plain = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern)
    assert not regex.compile(plain).match("") and re.search(r"\)(?:[*+]|\{\d+,\})(?!\+)", pattern) is None
