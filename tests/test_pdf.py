import struct
import zlib

import pytest

from docveil.sinks.pdf_writer import redact
from docveil.sources import pdf
from docveil.sources.pdf_fonts import TrueType, to_unicode
from docveil.sources.pdf_objects import Document, Lexer, Name, PdfError, Ref, unpredicted
from tests import pdfs


def show(content: bytes):
    return pdf.document_letters(pdfs.pages(content))


def line(letters):
    return "".join(x["value"] for x in letters)


def test_lexer():
    lex = Lexer(rb"<</A#20B (a\(b\)\051\n(c)) /C [1 -2.5 .5 true null 3 0 R] /D <48 6>>> % c" + b"\n/E")
    assert lex.object() == {"A B": b"a(b))\n(c)", "C": [1, -2.5, 0.5, True, None, Ref(3)], "D": b"H`"}
    assert lex.object() == "E"
    with pytest.raises(EOFError):
        lex.object()


def test_simple_font_positions():
    got = show(b"BT /F1 12 Tf 100 200 Td (Hi) Tj ET")
    assert line(got) == "Hi"
    assert got[0]["bbox"] == {"x": 100.0, "y": 200 - 12 * 0.2, "width": 6.0, "height": pytest.approx(10.8)}
    assert got[1]["bbox"]["x"] == 106.0 and got[1]["baseline_y"] == 200.0
    assert got[1]["src"] == {"op_index": 3, "array_item": None, "byte_start": 1, "byte_len": 1}


def test_kerning_and_arrays():
    got = show(b"BT /F1 10 Tf 0 0 Td [(A) -1000 (B)] TJ ET")
    assert [x["bbox"]["x"] for x in got] == [0.0, 15.0]
    assert [x["src"]["array_item"] for x in got] == [0, 2]


def test_matrices_and_state():
    got = show(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 5 Td (A) Tj ET Q Q BT 1 0 0 1 7 8 Tm (B) Tj T* (C) Tj ET")
    assert [(x["bbox"]["x"], x["baseline_y"]) for x in got] == [(20.0, 30.0), (7.0, 8.0), (7.0, -2.0)]
    assert got[2]["font_size"] == 10.0  # raw size, whatever the matrices


def test_rotated_text_and_unseen_characters_are_left_out():
    assert show(b"BT /F1 10 Tf 0 1 -1 0 50 50 Tm (no) Tj ET") == []
    got = pdf.Interpreter({}).run("BT 0 0 Td (a​\tb) Tj ET".encode())
    assert line(got) == "ab" and got[1]["bbox"]["x"] == 4.5  # what isn't seen doesn't move on


def test_no_decoder_reads_utf8_or_nothing():
    assert line(pdf.Interpreter({}).run("BT (Léa) Tj ET".encode())) == "Léa"
    assert pdf.Interpreter({}).run(b"BT (\xff\xfe) Tj ET") == []
    assert [x["src"]["byte_len"] for x in pdf.Interpreter({}).run("BT (Lé) Tj ET".encode())] == [1, 2]


def test_quotes_show_without_moving_and_other_operators_are_ignored():
    got = show(b"BT /F1 10 Tf 5 Tc 3 TL 0 0 Td (a) Tj (b) ' 1 2 (c) \" ET /X Do BI /W 1 ID \x00 (z) Tj EI BT (d) Tj ET")
    assert line(got) == "abcd"
    assert [x["bbox"]["x"] for x in got[:3]] == [0.0, 5.0, 10.0]


def test_missing_operands_fail():
    for bad in (b"1 0 0 cm", b"1 0 Tm", b"5 Td"):
        with pytest.raises(PdfError):
            show(bad)


def test_to_unicode():
    cmap = b"2 beginbfchar\n<0003> <0041>\n<0004> <D83DDE00>\nendbfchar\n1 beginbfrange\n<0010> <0012> <0061>\n<0020> <0021> [<0041> <0042>]\nendbfrange"
    assert to_unicode(cmap) == {3: "A", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "A"} or to_unicode(cmap) == {3: "A", 0x10: "a", 0x11: "b", 0x12: "c", 0x20: "A", 0x21: "B"}


def truetype() -> bytes:
    """A font of three glyphs: A and B have ink and widths, .notdef has none."""
    head = bytearray(54)
    head[18:20] = struct.pack(">H", 1000)
    glyf = struct.pack(">hhhhh", 0, 0, -100, 500, 700) + struct.pack(">hhhhh", 0, 0, 0, 500, 800)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 0x42, 0xFFFF, 0, 0x41, 0xFFFF, (1 - 0x41) & 0xFFFF, 1, 0, 0)
    tables = {
        b"cmap": cmap, b"glyf": glyf, b"head": bytes(head), b"hhea": bytes(34) + struct.pack(">H", 3), b"hmtx": struct.pack(">HhHhHh", 0, 0, 600, 0, 700, 0),
        b"loca": struct.pack(">HHHH", 0, 0, 5, 10), b"maxp": struct.pack(">IH", 0x10000, 3),
    }
    out, at, body = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, data in tables.items():
        out += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data
    return out + body


def test_truetype():
    face = TrueType(truetype())
    assert face.glyph_of() == {0x41: 1, 0x42: 2}
    assert face.advance(1) == 0.6 and face.advance(9) is None
    assert face.ink([0, 1, 2]) == (0.9, -0.1) and face.ink([0]) == (0.7, 0.0)


@pytest.mark.parametrize("with_map", [False, True])
def test_composite_font(with_map):
    extra = {
        3: b"<</Type/Font/Subtype/Type0/DescendantFonts[4 0 R]" + (b"/ToUnicode 7 0 R" if with_map else b"") + b">>",
        4: b"<</Type/Font/Subtype/CIDFontType2/FontDescriptor 5 0 R>>", 5: b"<</Type/FontDescriptor/FontFile2 6 0 R>>", 6: pdfs.stream(truetype(), flate=True),
        7: pdfs.stream(b"1 beginbfchar\n<0001> <0391>\nendbfchar"),
    }
    got = pdf.document_letters(pdfs.pages(b"BT /F1 10 Tf 0 0 Td <000100020009> Tj ET", extra=extra))
    assert line(got) == ("Α" if with_map else "AB")
    assert got[0]["bbox"]["width"] == 6.0 and got[0]["src"]["byte_len"] == 2
    assert got[0]["bbox"]["height"] == pytest.approx(8.0 if with_map else 9.0)


def test_flate_pages_and_order():
    data = pdfs.pages(pdfs.text("one"), pdfs.text("two"), flate=True)
    got = pdf.document_letters(data)
    assert [line([x for x in got if x["page_no"] == n]) for n in (1, 2)] == ["one", "two"]
    assert [x["seq"] for x in got if x["page_no"] == 2] == [0, 1, 2]


def test_broken_cross_references_are_scanned():
    data = pdfs.pages(pdfs.text("found"))
    cut = data[: data.rfind(b"xref\n0")] + b"trailer\n<</Root 1 0 R>>\nstartxref\n99999\n%%EOF"
    assert line(pdf.document_letters(cut)) == "found"


def test_object_and_reference_streams():
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[4 0 R]/Count 1>>"), (3, pdfs.FONT), (4, b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 3 0 R>>>>/Contents 5 0 R>>")]
    heads, bodies = b"", b""
    for num, body in inner:
        heads += b"%d %d " % (num, len(bodies))
        bodies += body + b" "
    out = bytearray(b"%PDF-1.5\n")
    places = {}
    for num, body in ((5, pdfs.stream(pdfs.text("packed"))), (6, pdfs.stream(heads + bodies, b"/Type/ObjStm/N 4/First %d" % len(heads), flate=True))):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    rows = [(0, 0, 0), *((2, 6, k) for k in range(4)), (1, places[5], 0), (1, places[6], 0), (1, len(out), 0)]
    raw = b"".join(struct.pack(">BHB", *r) for r in rows)
    predicted = b"".join(b"\x02" + bytes((raw[i + j] - (raw[i - 4 + j] if i else 0)) & 255 for j in range(4)) for i in range(0, len(raw), 4))
    out_at = len(out)
    out += b"7 0 obj\n" + pdfs.stream(predicted, b"/Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>", flate=True) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % out_at
    assert line(pdf.document_letters(bytes(out))) == "packed"


def test_predictors():
    assert unpredicted(b"\x01\x01\x01\x01", {"Predictor": 15, "Columns": 3}) == b"\x01\x02\x03"
    assert unpredicted(b"\x01\x01\x01", {"Predictor": 2, "Columns": 3}) == b"\x01\x02\x03"


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\n<</Type/Cat"])
def test_unreadable(data):
    with pytest.raises(PdfError):
        Document(data)


def test_redaction_erases_and_boxes():
    data = pdfs.pages(pdfs.text("secret word"), pdfs.text("public"), flate=True)
    letters = [x for x in pdf.document_letters(data) if x["page_no"] == 1][:6]
    out = redact(data, [{"page_no": 1, "bbox": {"x": 50, "y": 698, "width": 30, "height": 9}, "letters": [x["src"] for x in letters]}])
    doc = Document(out)
    first, second = (doc.content(p) for _, p in doc.pages())
    assert b"secret" not in first and b"public" in second
    assert b"736563726574" not in out and b"secret" not in zlib.decompress(next(s.data for s in [doc.get(doc.pages()[0][1]["Contents"])]))
    ops = [(name, args) for name, args, _, _ in pdf.operations(first)]
    assert ops[0][0] == "q" and [n for n, _ in ops[-7:]] == ["q", "w", "rg", "RG", "re", "B", "Q"]
    assert ops[-3][1] == [49, 697, 32, 11] and ops[-5][1] == [1, 1, 1] and ops[-4][1] == [0, 0, 0]
    assert next(args for n, args in ops if n == "Tj")[0][:6] == bytes(6)


def test_redaction_keeps_other_text_and_array_items():
    data = pdfs.pages(b"BT /F1 10 Tf 0 0 Td [(AB) -10 (CD)] TJ (E) Tj ET")
    letters = pdf.document_letters(data)
    out = redact(data, [{"page_no": 1, "bbox": letters[2]["bbox"], "letters": [letters[2]["src"]]}])
    ops = [(n, a) for n, a, _, _ in pdf.operations(Document(out).content(Document(out).pages()[0][1]))]
    assert ("TJ", [[b"AB", -10, b"\0D"]]) in ops and ("Tj", [b"E"]) in ops


def test_faces_are_emptied():
    extra = {20: pdfs.stream(b"JPEGDATA", b"/Type/XObject/Subtype/Image/Width 2/Height 3/Filter/DCTDecode")}
    data = pdfs.build({1: b"<</Type/Catalog/Pages 2 0 R/Pic 20 0 R>>", 2: b"<</Type/Pages/Kids[]/Count 0>>", **extra})
    (num, image), = Document(data).images()
    assert num == 20 and Document(data).decoded(image) == b"JPEGDATA"
    out = redact(data, [], [20])
    (_, image), = Document(out).images()
    assert b"JPEGDATA" not in out and Document(out).decoded(image) == b"" and image.dict["Width"] == 2 and image.dict["Filter"] == "FlateDecode"


def test_files_to_letters(spark):
    rows = [("a.pdf", bytearray(pdfs.pages(pdfs.text("hello")))), ("b.pdf", bytearray(b"junk")), ("c.pdf", None)]
    got = pdf.letters(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert "".join(r.value for r in got if r.doc == "a.pdf") == "hello"
    assert {r.doc: r.error for r in got if r.error} == {"b.pdf": "PdfError: no PDF header", "c.pdf": "PdfError: no content"}


def test_data_source(spark, tmp_path):
    from docveil.sources.datasource import register

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(pdfs.pages(pdfs.text("hello")))
    (tmp_path / "in" / "x.anon.pdf").write_bytes(b"junk")
    register(spark)
    got = spark.read.format("pdf_letters").load(str(tmp_path)).orderBy("seq").collect()
    assert "".join(r.value for r in got) == "hello" and got[0].src.op_index == 3


def test_names_and_numbers_are_written():
    from docveil.sources.pdf_objects import written

    assert written({"A": [Name("b c"), 1, 1.5, None, True, b"x", Ref(2)]}) == b"<</A [/b#20c 1 1.5 null true <78> 2 0 R]>>"
