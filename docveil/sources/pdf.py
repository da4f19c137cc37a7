"""PDF files as DataFrames: letters, images and the state of every file.

A content stream is a program whose every operator depends on the ones before, so each
file is interpreted by one Python call, in Arrow batches; files are independent and spread
over the cluster. A file that can't be read gives one row with a message and no letters,
and so does one without any letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docveil.sources.pdf_fonts import Decoder, decoder
from docveil.sources.pdf_objects import Document, Keyword, Lexer, Name, PdfError

# Font size before any is set, glyphs of fonts that can't be decoded, the least scale that text is read at.
FONT_SIZE = 10.0
PLAIN_WIDTH, PLAIN_HEIGHT, PLAIN_OFFSET = 0.45, 0.9, -0.2
LEAST_SCALE = 0.1
#: Images of several files are handed on together, up to about so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 5_000
UNSEEN = {"​", "﻿"}
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

LETTERS = "doc string, page_no int, seq int, value string, bbox struct<x:double,y:double,width:double,height:double>, font_size double, baseline_y double, src struct<op_index:int,array_item:int,byte_start:int,byte_len:int>, error string"

_double = pa.float64()
LETTERS_ARROW = pa.schema([
    ("doc", pa.string()), ("page_no", pa.int32()), ("seq", pa.int32()), ("value", pa.string()), ("bbox", pa.struct([(k, _double) for k in ("x", "y", "width", "height")])), ("font_size", _double), ("baseline_y", _double),
    ("src", pa.struct([(k, pa.int32()) for k in ("op_index", "array_item", "byte_start", "byte_len")])), ("error", pa.string()),
])
IMAGES_ARROW = pa.schema([("doc", pa.string()), ("obj_id", pa.int32()), ("filter", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def product(m, n):
    """First m, then n, for row vectors."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def moved(x: float, y: float, m):
    return product((1.0, 0.0, 0.0, 1.0, x, y), m)


def operations(content: bytes) -> Iterator[tuple[str, list, int, int]]:
    """(operator, operands, first byte, end) of a content stream; an inline image is one operation without operands."""
    lex, operands, start = Lexer(content), [], 0
    while True:
        try:
            x = lex.object()
        except EOFError:
            return
        if not isinstance(x, Keyword):
            operands.append(x)
            continue
        if x == "BI":
            data = content.find(b"ID", lex.at)
            end = content.find(b"EI", data)
            while end >= 0 and (content[end - 1 : end] not in (b" ", b"\n", b"\r", b"\t") or content[end + 2 : end + 3] not in (b" ", b"\n", b"\r", b"\t", b"")):
                end = content.find(b"EI", end + 2)
            lex.at = end + 2 if data >= 0 and end >= 0 else len(content)
            operands = []
        yield str(x), operands, start, lex.at
        operands, start = [], lex.at


def _number(x) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


class Interpreter:
    """The text state of a page; `letters` collects what is shown."""

    def __init__(self, fonts: dict[str, Decoder | None]):
        self.fonts, self.font, self.size = fonts, None, FONT_SIZE
        self.page, self.saved = IDENTITY, []
        self.text = self.line = IDENTITY
        self.letters: list[dict] = []

    def run(self, content: bytes) -> list[dict]:
        for k, (name, args, _, _) in enumerate(operations(content)):
            method = self.table.get(name)
            if method:
                method(self, k, args)
        return self.letters

    def _save(self, k, args):
        self.saved.append(self.page)

    def _restore(self, k, args):
        if self.saved:
            self.page = self.saved.pop()

    def _transform(self, k, args):
        if len(args) < 6:
            raise PdfError("cm needs six operands")
        self.page = product([_number(a) for a in args[:6]], self.page)

    def _font(self, k, args):
        if args and isinstance(args[0], Name):
            self.font = self.fonts.get(args[0])
        if len(args) > 1 and isinstance(args[1], (int, float)):
            self.size = float(args[1])

    def _begin(self, k, args):
        self.text = self.line = IDENTITY

    def _move(self, k, args):
        if len(args) < 2:
            raise PdfError("Td needs two operands")
        self.text = self.line = moved(_number(args[0]), _number(args[1]), self.line)

    def _matrix(self, k, args):
        if len(args) < 6:
            raise PdfError("Tm needs six operands")
        self.text = self.line = tuple(_number(a) for a in args[:6])

    def _next_line(self, k, args):
        self.text = self.line = moved(0.0, -self.size, self.line)

    def _show(self, k, args):
        if args and isinstance(args[-1], bytes):
            self._string(args[-1], k, None)

    def _show_spaced(self, k, args):
        if not args or not isinstance(args[0], list):
            return
        for i, item in enumerate(args[0]):
            if isinstance(item, bytes):
                self._string(item, k, i)
            elif isinstance(item, (int, float)):
                self.text = moved(-(item / 1000.0) * self.size, 0.0, self.text)

    def _string(self, data: bytes, k: int, item: int | None) -> None:
        if self.font is not None:
            glyphs, height, offset = self.font.glyphs(data), self.font.height, self.font.offset
        else:
            glyphs, height, offset = [], PLAIN_HEIGHT, PLAIN_OFFSET
            try:
                at = 0
                for c in data.decode("utf-8"):
                    n = len(c.encode("utf-8"))
                    glyphs.append((c, PLAIN_WIDTH, at, n))
                    at += n
            except UnicodeDecodeError:
                glyphs = []
        for c, width, start, n in glyphs:
            at = product(self.text, self.page)
            if abs(at[0]) < LEAST_SCALE and abs(at[3]) < LEAST_SCALE or c in UNSEEN or unicodedata.category(c) == "Cc":
                continue  # what isn't seen doesn't move on either
            advance = self.size * width
            self.letters.append({
                "value": c, "bbox": {"x": at[4], "y": at[5] + self.size * offset, "width": advance, "height": self.size * height}, "font_size": self.size, "baseline_y": at[5],
                "src": {"op_index": k, "array_item": item, "byte_start": start, "byte_len": n},
            })
            self.text = moved(advance, 0.0, self.text)

    table = {"q": _save, "Q": _restore, "cm": _transform, "Tf": _font, "BT": _begin, "Td": _move, "TD": _move, "Tm": _matrix, "T*": _next_line, "Tj": _show, "'": _show, '"': _show, "TJ": _show_spaced}


def page_fonts(doc: Document, page: dict) -> dict[str, Decoder | None]:
    resources = doc.get(page.get("Resources"))
    fonts = doc.get(resources.get("Font")) if isinstance(resources, dict) else None
    out: dict[str, Decoder | None] = {}
    for name, ref in (fonts or {}).items():
        font = doc.get(ref)
        out[name] = decoder(doc, font) if isinstance(font, dict) else None
    return out


def document_letters(data: bytes) -> list[dict]:
    """Letters of all pages with page_no (from 1) and seq (from 0 on each page)."""
    doc = Document(data)
    out = []
    for n, (_, page) in enumerate(doc.pages(), 1):
        for seq, letter in enumerate(Interpreter(page_fonts(doc, page)).run(doc.content(page))):
            out.append({"page_no": n, "seq": seq, **letter})
    return out


def letters(files: DataFrame, doc_col: str = "path", content_col: str = "content") -> DataFrame:
    """LETTERS of every file; one row with `error` and nulls for a file that can't be read (null content among them) or shows no letter."""

    def run(batches):
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if content is None:
                        raise PdfError("no content")
                    rows = [{"doc": doc, "error": None, **x} for x in document_letters(content)]
                    if not rows:
                        raise PdfError("no letters")
                except Exception as e:  # one bad file must not end the job
                    rows = [{"doc": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=LETTERS_ARROW)

    return files.select(doc_col, content_col).mapInArrow(run, LETTERS)


def images(files: DataFrame, doc_col: str = "path", content_col: str = "content") -> DataFrame:
    """doc, obj_id, filter, content (image files as they stand, else decoded samples) of every image object; error for unreadable files."""

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if content is None:
                        raise PdfError("no content")
                    d = Document(content)
                    own = [{"doc": doc, "obj_id": num, "filter": ",".join(d.filters(s)), "content": d.decoded(s)} for num, s in d.images()]
                except Exception as e:
                    own = [{"doc": doc, "error": f"{type(e).__name__}: {e}"}]
                rows += own
                held += sum(len(x.get("content", b"")) for x in own)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=IMAGES_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=IMAGES_ARROW)

    return files.select(doc_col, content_col).mapInArrow(run, "doc string, obj_id int, filter string, content binary, error string")
