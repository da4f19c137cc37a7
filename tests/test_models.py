import numpy as np
import pytest

from docveil.operators import faces, ner
from docveil.sources import listing

LABELS = ["O", "B-PER", "I-PER", "B-ORG", "B-LOC", "LOC"]


def decode(text, tokens, classes, special=None):
    """tokens as (start, end) in the text; classes by number."""
    words = [text[a:b] or "[CLS]" for a, b in tokens]
    return ner.decode_window(text, words, tokens, special or [False] * len(tokens), classes, [0.5] * len(tokens), LABELS)


def test_labels_and_bio():
    assert ner.labels_of('{"id2label": {"1": "B-PER", "0": "O", "x": "no", "10": "I-PER", "2": "LOC"}}') == ["O", "B-PER", "LOC", "I-PER"]
    assert ner.labels_of("{}") == []
    assert [ner.bio(x) for x in ("B-PER", "I_PER", "PER", "X-PER", "B-A_B", "I_A-B")] == [("B", "PER"), ("I", "PER"), ("B", "PER"), ("B", "X-PER"), ("B", "A_B"), ("I", "A-B")]


def test_predictions_take_the_last_of_equal():
    classes, scores = ner.predictions(np.array([[1, 3, 3], [0, 0, 0], [5, 0, 0]], np.float32))
    assert classes.tolist() == [1 + 1, 2, 0] and scores[1] == pytest.approx(1 / 3)


def test_subwords_extend_under_any_label():
    assert decode("Jean, va", [(0, 2), (2, 4), (4, 5), (6, 8)], [1, 0, 3, 0]) == [(0, 4, "PER", 0.5)]  # the comma is trimmed


def test_walk_back_and_tags():
    assert decode("Dupont Paris", [(0, 3), (3, 6), (7, 12)], [0, 1, 4]) == [(0, 6, "PER", 0.5), (7, 12, "LOC", 0.5)]
    assert decode("a b", [(0, 1), (2, 3)], [2, 2]) == [(0, 3, "PER", 0.5)]  # I opens, I of the same tag goes on
    assert decode("a b", [(0, 1), (2, 3)], [1, 1]) == [(0, 1, "PER", 0.5), (2, 3, "PER", 0.5)]
    assert decode("a b c", [(0, 1), (2, 3), (4, 5)], [1, 3, 2]) == [(0, 1, "PER", 0.5), (4, 5, "PER", 0.5)]  # ORG closes and is dropped
    assert decode("a b", [(0, 1), (2, 3)], [1, 99]) == [(0, 1, "PER", 0.5)]


def test_specials_are_passed_over():
    assert decode("a b", [(0, 0), (0, 1), (0, 0), (2, 3)], [1, 1, 0, 2], [True, False, True, False]) == [(0, 3, "PER", 0.5)]


def test_trim_and_merge():
    assert ner.trimmed(" (Jean). ", 0, 9) == (2, 6) and ner.trimmed("...", 0, 3) == (0, 0)
    text = "Jean  Dupont, Paris"
    assert ner.merged(text, [(0, 4, "PER", 0.4), (6, 12, "PER", 0.8), (14, 19, "LOC", 0.5)]) == [(0, 12, "PER", pytest.approx(0.6)), (14, 19, "LOC", 0.5)]
    assert len(ner.merged("a,b", [(0, 1, "PER", 1.0), (2, 3, "PER", 1.0)])) == 2


class Words:
    """A tokenizer that cuts at blanks."""

    def encode(self, text):
        self.offsets, at = [], 0
        for w in text.split(" "):
            self.offsets.append((at, at + len(w)))
            at += len(w) + 1
        self.tokens = [text[a:b] for a, b in self.offsets]
        self.ids = [1 if t[:1].isupper() else 2 for t in self.tokens]
        self.attention_mask, self.special_tokens_mask = [1] * len(self.ids), [0] * len(self.ids)
        return self


def score(ids, mask):
    assert ids.shape[1] == 512
    if (ids == 1).sum() == 13:
        raise RuntimeError("no luck")
    out = np.zeros((*ids.shape, 3), np.float32)
    out[..., 0], out[..., 1] = ids == 2, ids == 1
    return out


def test_windows_and_errors(spark):
    texts = ["Jean va", " ".join(["x"] * 511 + ["Jean", "Dupont"]), "", None, " ".join(["X"] * 13)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = ner.ner_spans(df, ["id"], lambda: (score, Words(), ["O", "I-PER", "O"])).collect()
    assert sorted((r.id, r.start_pos, r.end_pos, r.label) for r in got if not r.error) == [(0, 0, 4, "PER"), (1, 1022, 1033, "PER")]
    assert [(r.id, r.error) for r in got if r.error] == [(4, "RuntimeError('no luck')")]


def test_merge_adjacent(spark):
    spans = spark.createDataFrame([(1, 0, 4, "PER", 0.5), (1, 5, 7, "PER", 1.0), (1, 8, 9, "LOC", 1.0), (2, 0, 1, "PER", None)], "id int, start_pos int, end_pos int, label string, score float")
    texts = spark.createDataFrame([(1, "Jean Du, x"), (2, "a")], "id int, text string")
    got = sorted((r.id, r.start_pos, r.end_pos, r.label, r.score, r.n_parts) for r in ner.merge_adjacent(spans, texts, ["id"]).collect())
    assert got == [(1, 0, 7, "PER", 0.75, 2), (1, 8, 9, "LOC", 1.0, 1), (2, 0, 1, "PER", None, 1)]


def test_faces(spark):
    assert faces.has_face(np.array([[[0.0, 0.71]]])) and not faces.has_face(np.array([[[0.9, 0.7]]])) and not faces.has_face(np.array([0.0, 0.9]))
    flat = faces.tensor(np.full((10, 20, 3), 255, np.uint8))
    assert flat.shape == (1, 3, 240, 320) and np.allclose(flat, 1.0)
    same = np.arange(240 * 320 * 3, dtype=np.uint32).reshape(240, 320, 3).astype(np.uint8)
    assert np.allclose(faces.tensor(same)[0].transpose(1, 2, 0) * 128 + 127, same)
    df = spark.createDataFrame([("d", 1, bytearray(b"\xff")), ("d", 2, bytearray(b"\x00")), ("d", 3, None)], "doc string, obj_id int, content binary")
    got = faces.marked(df, lambda: lambda x: np.array([[[0.0, float(x.max())]]]), lambda b: np.full((4, 4, 3), b[0], np.uint8)).collect()
    assert {r.obj_id: (r.has_face, r.error is None) for r in got} == {1: (True, True), 2: (False, True), 3: (False, False)}


def test_equal_pictures_are_scored_once(spark):
    def load():
        calls = []

        def score(x):
            calls.append(x)
            if len(calls) > 2:
                raise RuntimeError("scored again")
            return np.array([[[0.0, float(x.max())]]])

        return score

    df = spark.createDataFrame([("d", k, bytearray([255 * (k % 2)])) for k in range(6)], "doc string, obj_id int, content binary").coalesce(1)
    got = faces.marked(df, load, lambda b: np.full((4, 4, 3), b[0], np.uint8)).collect()
    assert {r.obj_id: (r.has_face, r.error) for r in got} == {k: (k % 2 == 1, None) for k in range(6)}


@pytest.mark.parametrize("query", ["pdf_face_marks", "pdf_purged_images", "ner_windows"])
def test_small_tables_are_dealt_over_the_cores(spark, query):
    import __spark_entry__ as e

    plan = e.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().logical().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan


def png(gray: int) -> bytes:
    """A picture of 4 by 3 pixels of one grey."""
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([gray] * 12) for _ in range(3))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_faces_from_image_source(spark, tmp_path):
    rows = [("d", 1, bytearray(png(255))), ("d", 2, bytearray(png(0))), ("d", 3, bytearray(b"junk")), ("e", 1, None)]
    df = spark.createDataFrame(rows, "doc string, obj_id int, content binary")
    got = faces.from_image_source(df, lambda: lambda x: np.array([[[0.0, float(x.mean())]]]), str(tmp_path / "images")).collect()
    assert {(r.doc, r.obj_id): (r.has_face, r.error is None) for r in got} == {("d", 1): (True, True), ("d", 2): (False, True), ("d", 3): (False, False), ("e", 1): (False, False)}


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "b.anon.pdf", "deep/c.pdf", "x.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    files = listing.read_files(spark, [str(tmp_path), str(tmp_path / "x.txt")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in listing.pending(files).collect()) == ["a.pdf", "c.pdf", "x.txt"]
    assert listing.read_files(spark, []).count() == 0
    assert {bytes(r.content) for r in files.collect()} == {b"x"}
    # folders in folders and files in folders are listed once
    twice = [str(tmp_path), str(tmp_path / "deep"), str(tmp_path / "a.pdf"), str(tmp_path / "x.txt"), str(tmp_path / "x.txt")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in listing.listed(spark, twice).collect()) == ["a.pdf", "b.anon.pdf", "b.pdf", "c.pdf", "x.txt"]
    gone = spark.createDataFrame([(str(tmp_path / "none.pdf"), 1)], "path string, length long")
    assert [r.content for r in listing.with_content(gone).collect()] == [None]
    assert listing.model_folder(str(tmp_path / "deep")) is None
    for f in listing.MODEL_FILES:
        (tmp_path / "models" / "pii").mkdir(parents=True, exist_ok=True)
        (tmp_path / "models" / "pii" / f).write_bytes(b"")
    assert listing.model_folder(str(tmp_path / "deep")) == str(tmp_path / "models")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "masked_text", "n_masked", "n_spans"]
    assert set(e.oracle_sql()) <= set(e.queries())
