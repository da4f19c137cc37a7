"""What the codes of a PDF font stand for, and how wide and high its glyphs are."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from docveil.sources.pdf_objects import Document, Stream

# Width, height and offset (in ems) where a font tells none.
WIDTH, HEIGHT, OFFSET = 0.5, 0.9, -0.2
NO_INK = (0.7, 0.0)
PROBED = range(0x20, 0x3000)


@dataclass
class Decoder:
    """Codes of one font: bytes each, character and width (ems) by code, extent of its ink."""

    bytes_per_code: int
    chars: dict[int, str]
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = WIDTH
    height: float = HEIGHT
    offset: float = OFFSET

    def glyphs(self, data: bytes) -> list[tuple[str, float, int, int]]:
        """(character, width, first byte, bytes) of every known code; unknown ones and a rest are left out."""
        n = self.bytes_per_code
        out = []
        for i in range(0, len(data) - n + 1, n):
            code = int.from_bytes(data[i : i + n], "big")
            if code in self.chars:
                out.append((self.chars[code], self.widths.get(code, self.default_width), i, n))
        return out


class TrueType:
    """The tables of a TrueType font that widths, ink and characters need."""

    def __init__(self, data: bytes):
        self.data = data
        count = struct.unpack(">H", data[4:6])[0]
        self.tables = {data[12 + 16 * i : 16 + 16 * i].decode("latin-1"): struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(count)}
        head = self._table("head")
        self.em = struct.unpack(">H", head[18:20])[0] or 1000
        self.long_loca = struct.unpack(">h", head[50:52])[0] == 1
        self.n_glyphs = struct.unpack(">H", self._table("maxp")[4:6])[0]
        self.n_widths = struct.unpack(">H", self._table("hhea")[34:36])[0]

    def _table(self, tag: str) -> bytes:
        offset, length = self.tables[tag]
        return self.data[offset : offset + length]

    def advance(self, gid: int) -> float | None:
        """Width in ems."""
        if gid >= self.n_glyphs or not self.n_widths:
            return None
        at = 4 * min(gid, self.n_widths - 1)
        raw = self._table("hmtx")[at : at + 2]
        return struct.unpack(">H", raw)[0] / self.em if len(raw) == 2 else None

    def box(self, gid: int) -> tuple[int, int] | None:
        """Lowest and highest point of a glyph's ink; none for empty glyphs."""
        if gid >= self.n_glyphs or "glyf" not in self.tables:
            return None
        loca = self._table("loca")
        if self.long_loca:
            a, b = struct.unpack(">II", loca[4 * gid : 4 * gid + 8])
        else:
            a, b = (2 * x for x in struct.unpack(">HH", loca[2 * gid : 2 * gid + 4]))
        if b <= a:
            return None
        low, high = struct.unpack(">hxxh", self._table("glyf")[a + 4 : a + 10])
        return low, high

    def glyph_of(self) -> dict[int, int]:
        """Code point -> glyph of the Unicode subtables in formats 4 and 12."""
        if "cmap" not in self.tables:
            return {}
        c = self._table("cmap")
        out: dict[int, int] = {}
        for i in range(struct.unpack(">H", c[2:4])[0]):
            platform, encoding, at = struct.unpack(">HHI", c[4 + 8 * i : 12 + 8 * i])
            if not (platform == 0 or platform == 3 and encoding in (1, 10)):
                continue
            kind = struct.unpack(">H", c[at : at + 2])[0]
            if kind == 4:
                n = struct.unpack(">H", c[at + 6 : at + 8])[0] // 2
                words = lambda p, k: struct.unpack(f">{k}H", c[p : p + 2 * k])
                ends, starts = words(at + 14, n), words(at + 16 + 2 * n, n)
                deltas, ranges = words(at + 16 + 4 * n, n), words(at + 16 + 6 * n, n)
                for k in range(n):
                    for code in range(starts[k], min(ends[k], 0xFFFE) + 1):
                        if ranges[k] == 0:
                            gid = (code + deltas[k]) & 0xFFFF
                        else:
                            p = at + 16 + 6 * n + 2 * k + ranges[k] + 2 * (code - starts[k])
                            raw = c[p : p + 2]
                            gid = struct.unpack(">H", raw)[0] if len(raw) == 2 else 0
                            gid = (gid + deltas[k]) & 0xFFFF if gid else 0
                        if gid:
                            out.setdefault(code, gid)
            elif kind == 12:
                for k in range(struct.unpack(">I", c[at + 12 : at + 16])[0]):
                    a, b, g = struct.unpack(">III", c[at + 16 + 12 * k : at + 28 + 12 * k])
                    # codes beyond Unicode and glyphs that the font doesn't have show nothing
                    for code in range(a, min(b, 0x10FFFF, a + self.n_glyphs - 1 - g) + 1):
                        out.setdefault(code, g + code - a)
        return out

    def ink(self, gids) -> tuple[float, float]:
        """Height and offset in ems of the ink of all the glyphs together."""
        boxes = [b for b in map(self.box, gids) if b]
        if not boxes:
            return NO_INK
        low, high = min(b[0] for b in boxes), max(b[1] for b in boxes)
        return (high - low) / self.em, low / self.em


_section = {kind: re.compile(rb"begin%s(.*?)(?:end%s|\Z)" % (kind, kind), re.S) for kind in (b"bfchar", b"bfrange")}
_hex = re.compile(rb"<\s*([0-9A-Fa-f\s]*)>")


def to_unicode(data: bytes) -> dict[int, str]:
    """Code -> character of a ToUnicode map: lines of single codes and of ranges; only the first character of a target counts."""
    out: dict[int, str] = {}
    for kind, needed in ((b"bfchar", 2), (b"bfrange", 3)):
        for section in _section[kind].finditer(data):
            for line in section[1].splitlines():
                words = [re.sub(rb"\s", b"", w) for w in _hex.findall(line)]
                if len(words) < needed or not all(words[:needed]):
                    continue
                first, last = int(words[0], 16), int(words[needed - 2], 16)
                target = int(words[needed - 1][:4], 16)
                # a code has two bytes at most, and a target beyond Unicode is no character
                for code in range(first, min(last, 0xFFFF, first + 0x10FFFF - target) + 1) if needed == 3 else (first,):
                    c = target + code - first
                    if not 0xD800 <= c < 0xE000:
                        out[code] = chr(c)
    return out


def decoder(doc: Document, font: dict) -> Decoder | None:
    """The decoder of a font dictionary; None for composite fonts without an embedded TrueType file."""
    if font.get("Subtype") == "Type0":
        below = doc.get(font.get("DescendantFonts"))
        inner = doc.get(below[0]) if isinstance(below, list) and below else None
        descriptor = doc.get(inner.get("FontDescriptor")) if isinstance(inner, dict) else None
        file = doc.get(descriptor.get("FontFile2")) if isinstance(descriptor, dict) else None
        if not isinstance(file, Stream):
            return None
        face = TrueType(doc.decoded(file))
        cmap = doc.get(font.get("ToUnicode"))
        chars = to_unicode(doc.decoded(cmap)) if isinstance(cmap, Stream) else {}
        if not chars:
            for code, gid in sorted(face.glyph_of().items()):
                if code in PROBED:
                    chars.setdefault(gid, chr(code))
        widths = {g: w for g in chars if (w := face.advance(g)) is not None}
        return Decoder(2, chars, widths, WIDTH, *face.ink(chars))
    if "Subtype" not in font:
        return None
    chars = {b: bytes([b]).decode("latin-1") for b in range(0x20, 0x100)}
    first, widths = doc.get(font.get("FirstChar")), doc.get(font.get("Widths"))
    table = {}
    if isinstance(first, int) and isinstance(widths, list):
        table = {first + i: w / 1000 for i, w in enumerate(map(doc.get, widths)) if isinstance(w, (int, float))}
    return Decoder(1, chars, table)
