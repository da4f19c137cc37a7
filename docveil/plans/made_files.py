"""Queries over PDF files and models that are made here, in whole, from the rows of a table.

What the files show follows from the rows by a rule, so that SQL can tell what reading,
redaction and token classification must give. A file holds one page of a document or one
row, so that files are small and spread over the cluster.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docveil.operators import faces, ner
from docveil.sinks import pdf_writer
from docveil.sources import pdf
from docveil.sources.pdf_objects import Document

# Fixed values of the made files: width of a code in the simple font, of a glyph in the composite one, and the extent of its ink (thousandths).
WIDTH = lambda code: 300 + code % 200
GLYPHS, GLYPH_WIDTH = 95, lambda g: 400 + 5 * g
INK = lambda g: (-g, 500 + g)


def file_of(objects: dict[int, bytes]) -> bytes:
    """A PDF file of object bodies; the first object is the catalog."""
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for num, body in sorted(objects.items()):
        places[num] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (num, body)
    at, size = len(out), max(objects) + 1
    table = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size))
    return bytes(out) + b"xref\n0 %d\n%btrailer\n<</Root 1 0 R/Size %d>>\nstartxref\n%d\n%%%%EOF\n" % (size, table, size, at)


def stream(data: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<<%b/Filter/FlateDecode/Length %d>>\nstream\n%b\nendstream" % (more, len(packed), packed)


def truetype() -> bytes:
    """A font whose glyph g (1 to GLYPHS) is the character U+0020 + g."""
    head = bytearray(54)
    head[18:20] = struct.pack(">H", 1000)
    boxes = b"".join(struct.pack(">hhhhh", 1, 0, INK(g)[0], 500, INK(g)[1]) for g in range(1, GLYPHS + 1))
    table = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 0x20 + GLYPHS, 0xFFFF, 0, 0x21, 0xFFFF, (1 - 0x21) & 0xFFFF, 1, 0, 0)
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + table, b"glyf": boxes, b"head": bytes(head), b"hhea": bytes(34) + struct.pack(">H", GLYPHS + 1),
        b"hmtx": b"".join(struct.pack(">Hh", GLYPH_WIDTH(g), 0) for g in range(GLYPHS + 1)), b"loca": struct.pack(f">{GLYPHS + 2}H", 0, *(5 * g for g in range(GLYPHS + 1))), b"maxp": struct.pack(">IH", 0x10000, GLYPHS + 1),
    }
    out, at, body = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, data in tables.items():
        out += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    return out + body


SIMPLE = b"<</Type/Font/Subtype/TrueType/FirstChar 32/Widths[%b]>>" % b" ".join(b"%d" % WIDTH(c) for c in range(32, 256))


def page_file(content: bytes, composite: bool = False, to_unicode: bytes | None = None) -> bytes:
    """One page; F1 is a simple font, F2 a composite one, any other name has no decoder."""
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 5 0 R%b>>>>/Contents 4 0 R>>" % (b"/F2 6 0 R" if composite else b""),
        4: stream(content), 5: SIMPLE,
    }
    if composite:
        objects |= {
            6: b"<</Type/Font/Subtype/Type0/DescendantFonts[7 0 R]%b>>" % (b"/ToUnicode 10 0 R" if to_unicode else b""), 7: b"<</Type/Font/Subtype/CIDFontType2/FontDescriptor 8 0 R>>",
            8: b"<</Type/FontDescriptor/FontFile2 9 0 R>>", 9: stream(truetype()),
        }
        if to_unicode:
            objects[10] = stream(to_unicode)
    return file_of(objects)


def _is_simple(text: str) -> bool:
    return all("\x20" <= c <= "\xff" for c in text)


def _plain(word) -> bytes:
    font, raw = (b"F1", word.text.encode("latin-1")) if _is_simple(word.text) else (b"F0", word.text.encode("utf-8"))
    return b"BT /%b %r Tf %r %r Td <%b> Tj ET\n" % (font, word.font_size, word.x, word.baseline_y, raw.hex().encode())


def _matrices(word) -> bytes:
    """A letter at the word's place and one a line below, both under a matrix; then one that is rotated, and a mark that no operator knows."""
    a, d = 0.5 + word.word_no % 4 * 0.5, 1.0 + word.page_no % 3
    return b"q %r 0 0 %r 7 -3 cm BT /F1 %r Tf 1 0 0 1 %r %r Tm (A) Tj T* (B) Tj ET Q Q BT 0 1 -1 0 5 5 Tm (R) Tj ET 3 Tc /X Do\n" % (a, d, word.font_size, word.x, word.baseline_y)


def _spaced(word) -> bytes:
    return b"BT /F1 %r Tf %r %r TD [(A) %d (B) -250.5 (C)] TJ (D) ' 1 2 (E) \" ET\n" % (word.font_size, word.x, word.baseline_y, word.word_no % 9 * 100 - 300)


def _composite(word) -> bytes:
    codes = b"".join(b"%04x" % (ord(c) - 0x20) for c in word.text)
    return b"BT /F2 %r Tf %r %r Td <%b7fff> Tj ET\n" % (word.font_size, word.x, word.baseline_y, codes)


#: Even pages have a map of their own to characters, which begins at the letter alpha.
TO_UNICODE = b"1 beginbfchar\n<0001> <03B1>\nendbfchar\n1 beginbfrange\n<0002> <%04x> <03B2>\nendbfrange" % GLYPHS


def files(words: DataFrame, write, composite: bool = False) -> DataFrame:
    """path ("doc/page") and content of a file for each page of words; `write` gives the operators of one word."""
    held = F.sort_array(F.collect_list(F.struct("word_no", "page_no", F.col("bbox.x").alias("x"), "baseline_y", "font_size", "text")))
    pages = words.groupBy("doc", "page_no").agg(held.alias("words")).select(F.concat_ws("/", "doc", F.col("page_no").cast("string")).alias("path"), "page_no", "words")

    def run(batches):
        for batch in batches:
            out = []
            for path, page_no, own in zip(*(c.to_pylist() for c in batch.columns)):
                content = b"".join(write(pd.Series(w)) for w in own)
                out.append({"path": path, "content": page_file(content, composite, TO_UNICODE if composite and page_no % 2 == 0 else None)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return pages.mapInArrow(run, "path string, content binary")


def shown(letters: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 4)
    return letters.select(
        F.col("doc").alias("file"), "page_no", "seq", "value", r("bbox.x").alias("x"), r("bbox.y").alias("y"), r("bbox.width").alias("width"), r("bbox.height").alias("height"), r("font_size").alias("font_size"),
        r("baseline_y").alias("baseline_y"), "error",
    )


def plain_files(words: DataFrame) -> DataFrame:
    return files(words.where("text <> ''"), _plain)


def plain_letters(words: DataFrame) -> DataFrame:
    """Letters of simple fonts, and of text whose font can't be decoded."""
    return shown(pdf.letters(plain_files(words)))


def matrix_letters(words: DataFrame) -> DataFrame:
    return shown(pdf.letters(files(words, _matrices)))


def spaced_letters(words: DataFrame) -> DataFrame:
    return shown(pdf.letters(files(words, _spaced)))


def composite_letters(words: DataFrame) -> DataFrame:
    return shown(pdf.letters(files(words.where(F.regexp_like("text", F.lit(r"^[\x21-\x7E]+$"))), _composite, composite=True)))


def redacted_files(words: DataFrame) -> DataFrame:
    """The plain files with every third word of a page redacted, beginning with the first."""
    made = plain_files(words)
    # a word is five operators, the fourth of which shows it
    place = ((F.col("src.op_index") - 3) / 5).cast("int")
    letters = pdf.letters(made).where("error is null").withColumn("place", place).where("place % 3 = 0")
    x, y = F.min("bbox.x"), F.min("bbox.y")
    box = F.struct(x.alias("x"), y.alias("y"), (F.max(F.col("bbox.x") + F.col("bbox.width")) - x).alias("width"), (F.max(F.col("bbox.y") + F.col("bbox.height")) - y).alias("height"))
    targets = letters.groupBy("doc", "page_no", "place").agg(box.alias("bbox"), F.collect_list("src").alias("letters"))
    return pdf_writer.redacted(made, targets)


def redacted_letters(words: DataFrame) -> DataFrame:
    """What can still be read after redaction."""
    return shown(pdf.letters(redacted_files(words), "doc")).where("error is null").drop("seq")


def redaction_boxes(words: DataFrame) -> DataFrame:
    """The boxes that were drawn, with colours of fill and line and the line's width, read from the written files."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                doc = Document(content)
                state: dict[str, list] = {}
                for name, args, _, _ in pdf.operations(b"".join(doc.content(p) for _, p in doc.pages())):
                    state[name] = [float(a) for a in args] if name in ("re", "rg", "RG", "w") else []
                    if name == "B":
                        rows.append([file, *(round(v, 4) for v in state["re"]), *state["rg"][:1], *state["RG"][:1], *state["w"]])
            yield pd.DataFrame(rows, columns=["file", "x", "y", "width", "height", "fill", "line", "line_width"]).pipe(pa.RecordBatch.from_pandas, preserve_index=False)

    return redacted_files(words).select("doc", "content").mapInArrow(run, "file string, x double, y double, width double, height double, fill double, line double, line_width double")


def image_files(customers: DataFrame) -> DataFrame:
    """A file for each customer with two images of one grey, c_custkey modulo 256 and its complement, and a stream that is none."""

    def run(batches):
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                image = b"/Type/XObject/Subtype/Image/Width 2/Height 2"
                body = {3: stream(bytes([key % 256] * 12), image), 4: stream(bytes([255 - key % 256] * 12), image), 5: stream(b"x" * 12, b"/Type/XObject/Subtype/Form")}
                out.append({"path": str(key), "content": file_of({1: b"<</Type/Catalog/Pages 2 0 R/Held[3 0 R 4 0 R 5 0 R]>>", 2: b"<</Type/Pages/Count 0/Kids[]>>", **body})})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return customers.select("c_custkey").mapInArrow(run, "path string, content binary")


def _scorer():
    """The brighter a picture, the likelier a face: (tensor + 1) / 2 as the score of the second class."""
    return lambda x: np.array([[[0.0, 0.0], [0.5, (float(x.mean()) + 1) / 2]]])


def face_marks(customers: DataFrame) -> DataFrame:
    """Images of the made files and whether they show a face."""
    found = faces.marked(pdf.images(image_files(customers)).where("error is null"), _scorer, lambda raw: np.frombuffer(raw, np.uint8).reshape(2, 2, 3))
    return found.select(F.col("doc").cast("long").alias("c_custkey"), "obj_id", "has_face", "error")


def purged_images(customers: DataFrame) -> DataFrame:
    """Sizes of the images' contents after those with faces have been emptied."""
    made = image_files(customers)
    marks = faces.marked(pdf.images(made).where("error is null"), _scorer, lambda raw: np.frombuffer(raw, np.uint8).reshape(2, 2, 3)).where("has_face").select("doc", "obj_id")
    none = pdf.letters(made).where("false").select("doc", "page_no", "bbox", F.array("src").alias("letters"))
    read = pdf.images(pdf_writer.redacted(made, none, marks), "doc")
    return read.groupBy(F.col("doc").cast("long").alias("c_custkey")).agg(F.count("obj_id").alias("n_images"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


# Fixed values of the made model: its words, the labels of its configuration, and the label of each word.
VOCABULARY = {"[UNK]": 0, "#": 1, "Jean": 2, "wrote": 3, "to": 4, "see": 5, "not": 6}
CONFIG = '{"id2label": {"0": "O", "2": "I-PER", "1": "B-PER", "3": "B-ORG", "x": "none"}}'
LABEL_OF = [2, 0, 1, 3, 0, 0, 0]


def _model():
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel(VOCABULARY, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    return (lambda ids, mask: 2.0 * np.eye(4)[np.array(LABEL_OF)[ids]]), tokenizer, ner.labels_of(CONFIG)


def entities(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of a made model: names, known by "Jean", and whatever word the model doesn't know."""
    return ner.ner_spans(texts, keys, _model).select(*keys, "start_pos", "end_pos", "label", F.round(F.col("score").cast("double"), 4).alias("score"), "error")


LONG = 40


def long_entities(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The same of each text written LONG times, which takes several windows. An entity that the end of a window cuts behind a full stop comes out in two."""
    many = texts.select(*keys, F.array_join(F.array_repeat("text", LONG), " ").alias("text"))
    return entities(many, keys).groupBy(*keys).agg((F.count("*") >= 4 * LONG).alias("all_found"), F.max("end_pos").alias("last_end"), F.min("start_pos").alias("first_start"))
