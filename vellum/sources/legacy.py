"""DOC, XLS and PPT: streams of an OLE2 container."""

from __future__ import annotations

import re
import struct

from .. import model as m
from .markup import TRIM, stem
from .ole import OleFile, summary_of

CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


# DOC


def _u16(b: bytes, at: int) -> int:
    return struct.unpack_from("<H", b, at)[0] if at + 2 <= len(b) else 0


def _u32(b: bytes, at: int) -> int:
    return struct.unpack_from("<I", b, at)[0] if at + 4 <= len(b) else 0


def _pieces(clx: bytes, word: bytes, most: int) -> str:
    """Text by the piece table: each piece is 8-bit (at half its offset) or UTF-16."""
    at = 0
    while at < len(clx) and clx[at] != 2:
        at += 3 + _u16(clx, at + 1) if clx[at] == 1 else 1
    n = (_u32(clx, at + 1) - 4) // 12
    at += 5
    if n <= 0 or at + 4 * (n + 1) + 8 * n > len(clx):
        return ""
    ends, text = struct.unpack_from(f"<{n + 1}I", clx, at), ""
    for k in range(n):
        count, fc = ends[k + 1] - ends[k], _u32(clx, at + 4 * (n + 1) + 8 * k + 2)
        if count <= 0:
            continue
        narrow, place = fc & 0x40000000, fc & 0x3FFFFFFF
        raw = word[place // 2 : place // 2 + count] if narrow else word[place : place + 2 * count]
        if len(raw) == count * (1 if narrow else 2):
            text += raw.decode("cp1252" if narrow else "utf-16-le", "replace")
        if 0 < most <= len(text):
            return text[:most]
    return text


def _inline(word: bytes, start: int, count: int) -> str:
    """Text right in the stream, at a sector's begin: UTF-16 if most high bytes are null, else 8-bit if readable."""
    places = [p for p in range(-(-start // 512) * 512, -(-start // 512) * 512 + 4097, 512) if p + 20 <= len(word)]
    for p in places:
        sample = word[p : p + 40]
        pairs = [(sample[i], sample[i + 1]) for i in range(0, len(sample) - 1, 2)]
        good = sum(hi == 0 and (lo >= 32 or lo in (9, 10, 13)) for lo, hi in pairs)
        if good >= 0.6 * len(sample) / 2 and p + 2 * count <= len(word):
            return word[p : p + 2 * count].decode("utf-16-le", "replace")
    for p in places:
        if sum(32 <= b <= 126 or b >= 128 or b in (10, 13) for b in word[p : p + 40]) >= 30 and p + count <= len(word):
            return word[p : p + count].decode("cp1252", "replace")
    return ""


def doc_text(ole: OleFile) -> str:
    word = ole.stream("WordDocument") or b""
    if len(word) < 68:
        return ""
    at = 34 + 2 * _u16(word, 32)
    longs, at = _u16(word, at), at + 2
    count = max(0, struct.unpack_from("<i", word, at + 12)[0]) if longs > 3 and at + 16 <= len(word) else 0
    at += 4 * longs
    n_pairs, pairs = _u16(word, at), at + 2
    end = pairs + 8 * n_pairs
    fc, size = (_u32(word, pairs + 8 * 66), _u32(word, pairs + 8 * 66 + 4)) if n_pairs > 66 else (0, 0)
    if size:
        which = ("1Table", "0Table") if _u16(word, 10) >> 9 & 1 else ("0Table", "1Table")
        side = ole.stream(which[0]) or ole.stream(which[1]) or b""
        text = _pieces(side[fc : fc + size], word, count) if fc + size <= len(side) else ""
        if text:
            return text
    after = end + 2 + 2 * _u16(word, end) if end + 2 <= len(word) else end
    text = _inline(word, after, count) if count else ""
    if text:
        return text
    return b"".join(re.findall(rb"[\x20-\x7e\t\r\n]{3,}", word[2048:])).decode("ascii")


def paragraphs_of(text: str) -> list[dict]:
    text = CONTROL.sub("", text.replace("\r\n", "\n").replace("\x07", "\t").replace("\x0c", "\n"))
    return [m.paragraph(x.strip(TRIM)) for x in re.split(r"[\r\n]+", text) if x.strip(TRIM)]


def parse_doc(data: bytes, name: str = "", **_) -> dict:
    ole = OleFile(data)
    title, meta = summary_of(ole, comments=True)
    return m.document("doc", title or stem(name), [m.section("main", paragraphs_of(doc_text(ole)))], meta)


# XLS

BOF, EOF, BOUNDSHEET, SST, CONTINUE = 0x809, 0x0A, 0x85, 0xFC, 0x3C
LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205


def number_text(x: float) -> str:
    if x == x and abs(x) < 1e15 and x == int(x):
        return str(int(x))
    return f"{x:.10f}".rstrip("0").rstrip(".")


def rk_number(rk: int) -> float:
    if rk & 2:
        value = float((rk >> 2) - (1 << 30 if rk & 0x80000000 else 0))
    else:
        (value,) = struct.unpack("<d", struct.pack("<II", 0, rk & 0xFFFFFFFC))
    return value / 100 if rk & 1 else value


class _Strings:
    """Strings of the shared table, which may break off in one record and go on in the next with a width of its own."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.k >= len(self.parts):
                raise struct.error("end of strings")
            got = self.parts[self.k][self.at : self.at + n]
            self.at += len(got)
            n -= len(got)
            out += got
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while count:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            here = min(count, (len(self.parts[self.k]) - self.at) // (2 if wide else 1))
            if not here:
                break
            text += self.take(here * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            count -= here
        self.take(4 * runs + extra)
        return text


def _records(book: bytes):
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        if at + 4 + size > len(book):
            return
        yield at, kind, book[at + 4 : at + 4 + size]
        at += 4 + size


def _name(raw: bytes) -> str:
    """A sheet's name: one byte of length, one of width."""
    return raw[2 : 2 + raw[0] * 2].decode("utf-16-le", "replace") if raw[1] & 1 else raw[2 : 2 + raw[0]].decode("latin-1")


def parse_xls(data: bytes, name: str = "", **_) -> dict:
    ole = OleFile(data)
    book = ole.stream("Workbook") or ole.stream("Book") or b""
    sheets: list[tuple[str, int]] = []
    strings: list[str] = []
    cells: dict[int, dict[tuple[int, int], str]] = {}
    begin, pending, parts = 0, None, None
    for at, kind, raw in _records(book):
        if kind != CONTINUE and parts is not None:
            total, reader = struct.unpack_from("<I", parts[0], 4)[0], _Strings([parts[0][8:], *parts[1:]])
            try:
                for _k in range(total):
                    strings.append(reader.string())
            except (struct.error, IndexError):
                pass
            parts = None
        here = cells.setdefault(begin, {}) if begin else {}
        try:
            if kind == BOF:
                begin = at
            elif kind == BOUNDSHEET:
                sheets.append((_name(raw[6:]), struct.unpack_from("<I", raw)[0]))
            elif kind == SST:
                parts = [raw]
            elif kind == CONTINUE and parts is not None:
                parts.append(raw)
            elif kind in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
                row, col = struct.unpack_from("<HH", raw)
                if kind == LABELSST:
                    k = struct.unpack_from("<I", raw, 6)[0]
                    here[row, col] = strings[k] if k < len(strings) else ""
                elif kind == LABEL:
                    here[row, col] = _Strings([raw[6:]]).string()
                elif kind == NUMBER:
                    here[row, col] = number_text(struct.unpack_from("<d", raw, 6)[0])
                elif kind == RK:
                    here[row, col] = number_text(rk_number(struct.unpack_from("<I", raw, 6)[0]))
                elif kind == MULRK:
                    for k in range((len(raw) - 6) // 6):
                        here[row, col + k] = number_text(rk_number(struct.unpack_from("<I", raw, 6 + 6 * k)[0]))
                elif kind == FORMULA:
                    if raw[12:14] == b"\xff\xff":
                        pending = (row, col) if raw[6] == 0 else None
                        if raw[6] == 1:
                            here[row, col] = "TRUE" if raw[8] else "FALSE"
                    else:
                        here[row, col] = number_text(struct.unpack_from("<d", raw, 6)[0])
                elif raw[7] == 0:
                    here[row, col] = "TRUE" if raw[6] else "FALSE"
            elif kind == STRING and pending:
                here[pending] = _Strings([raw]).string()
                pending = None
        except (struct.error, IndexError):
            continue
    made = []
    for label, at in sheets or [("Sheet1", next((b for b in cells if cells[b]), 0))]:
        grid = cells.get(at, {})
        if grid:
            width = max(c for _, c in grid) + 1
            rows = [[grid.get((r, c), "") for c in range(width)] for r in sorted({r for r, _ in grid})]
            made.append(m.section(label, [m.table([(k == 0, r) for k, r in enumerate(rows)])]))
    title, meta = summary_of(ole)
    return m.document("xls", title or stem(name), made, meta)


# PPT

TEXT_CHARS, TEXT_BYTES, CSTRING = 4000, 4008, 4026


def slide_texts(stream: bytes) -> list[str]:
    """Text atoms in order; containers are gone through."""
    out, at = [], 0
    while at + 8 <= len(stream):
        version, kind, size = struct.unpack_from("<HHI", stream, at)
        at += 8
        if version & 15 == 15:
            continue
        if at + size > len(stream):
            break
        if kind in (TEXT_CHARS, TEXT_BYTES, CSTRING):
            text = stream[at : at + size].decode("cp1252" if kind == TEXT_BYTES else "utf-16-le", "replace")
            text = CONTROL.sub("", text.replace("\r\n", "\n").replace("\r", "\n")).strip(TRIM)
            out += [text] if text else []
        at += size
    return out


def group_slides(texts: list[str]) -> list[list[str]]:
    """A short text (under 80) after a long one (over 100) begins a slide; up to three texts are one slide."""
    if len(texts) <= 3:
        return [texts] if texts else []
    out = [[texts[0]]]
    for before, text in zip(texts, texts[1:]):
        if len(text) < 80 and len(before) > 100:
            out.append([])
        out[-1].append(text)
    return out


def parse_ppt(data: bytes, name: str = "", **_) -> dict:
    ole = OleFile(data)
    slides = group_slides(slide_texts(next((ole.stream(n) for n in ole.names() if "powerpoint" in n), None) or b""))
    made = [m.section(f"slide-{k}", [m.paragraph(t) for t in texts]) for k, texts in enumerate(slides, 1)]
    title, meta = summary_of(ole)
    return m.document("ppt", title or stem(name), made, meta)
