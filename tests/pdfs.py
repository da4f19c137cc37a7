"""Small PDF files made by hand."""

import zlib


def build(objects: dict[int, bytes], root: int = 1) -> bytes:
    """A file of the given object bodies with a plain cross reference table."""
    out = bytearray(b"%PDF-1.4\n")
    places = {}
    for num, body in objects.items():
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    at = len(out)
    size = max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n"
    out += b"trailer\n<</Root %d 0 R/Size %d>>\nstartxref\n%d\n%%%%EOF\n" % (root, size, at)
    return bytes(out)


def stream(data: bytes, extra: bytes = b"", flate: bool = False) -> bytes:
    if flate:
        data, extra = zlib.compress(data), extra + b"/Filter/FlateDecode"
    return b"<<" + extra + b"/Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b" ".join([b"500"] * 224) + b"]>>"


def pages(*contents: bytes, flate: bool = False, extra: dict[int, bytes] | None = None) -> bytes:
    """One page for each content stream, all with font F1."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: FONT}
    kids = []
    for i, c in enumerate(contents):
        page, body = 10 + 2 * i, 11 + 2 * i
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % body
        objects[body] = stream(c, flate=flate)
    objects[2] = b"<</Type/Pages/Count %d/Kids[" % len(kids) + b" ".join(kids) + b"]>>"
    return build(dict(sorted((objects | (extra or {})).items())))


def text(line: str, x: float = 50, y: float = 700, size: float = 10) -> bytes:
    return b"BT /F1 %g Tf %g %g Td (" % (size, x, y) + line.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET\n"
