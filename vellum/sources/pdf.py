"""PDF: objects, content streams and their text with positions, by a small tokenizer."""

from __future__ import annotations

import re
import struct
import zlib

from .. import model as m
from ..operators.layout import Segment, page_elements
from .markup import TRIM, stem

FORM_DEPTH, IMAGE_DEPTH = 10, 5
KERN_SPACE = -100
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")


# Objects


class Pdf:
    """Objects by number, as bytes; those of object streams fill the gaps."""

    def __init__(self, data: bytes):
        self.data = data
        self.objects: dict[int, bytes] = {}
        for found in re.finditer(rb"(\d+)\s+\d+\s+obj\b", data):
            end = data.find(b"endobj", found.end())
            if end >= 0:
                self.objects[int(found[1])] = data[found.end() : end]
        for raw in [x for x in self.objects.values() if re.search(rb"/Type\s*/ObjStm\b", x)]:
            n, first, body = re.search(rb"/N\s+(\d+)", raw), re.search(rb"/First\s+(\d+)", raw), stream_of(raw)
            if not (n and first and body):
                continue
            start = int(first[1])
            numbers = [int(x) for x in re.findall(rb"\d+", body[:start])][: 2 * int(n[1])]
            places = [*numbers[1::2], len(body) - start]
            for k, number in enumerate(numbers[::2][: len(places) - 1]):
                self.objects.setdefault(number, body[start + places[k] : start + places[k + 1]])

    def at(self, ref: re.Match | None) -> bytes:
        return self.objects.get(int(ref[1]), b"") if ref else b""

    def value(self, raw: bytes, key: bytes) -> bytes:
        """What stands after a key: a dictionary or array in full, or the object it refers to."""
        found = re.search(rb"/" + key + rb"\b\s*", raw)
        if not found:
            return b""
        rest = raw[found.end() :]
        ref = REF.match(rest)
        if ref:
            return self.at(ref)
        if rest[:2] == b"<<":
            return balanced(rest, b"<<", b">>")
        return balanced(rest, b"[", b"]") if rest[:1] == b"[" else rest

    def resource(self, raw: bytes, key: bytes) -> dict[str, int]:
        """Names to object numbers of one kind of resource."""
        inside = self.value(raw, b"Resources") or raw
        return {a.decode("latin-1"): int(b) for a, b in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(inside, key))}


def balanced(raw: bytes, opens: bytes, closes: bytes) -> bytes:
    depth = 0
    for x in re.finditer(re.escape(opens) + b"|" + re.escape(closes), raw):
        depth += 1 if x[0] == opens else -1
        if not depth:
            return raw[: x.end()]
    return raw


def inflate(data: bytes) -> bytes | None:
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            continue
    return None


def raw_stream(raw: bytes) -> bytes:
    found = re.search(rb"stream\r?\n?", raw)
    end = raw.rfind(b"endstream")
    return raw[found.end() : end] if found and end > found.end() else b""


def stream_of(raw: bytes) -> bytes:
    """A stream's bytes, unpacked if Flate; bytes that are no text give nothing."""
    data = raw_stream(raw)
    if b"/FlateDecode" in raw:
        plain = inflate(data)
        if plain is not None:
            return plain
    head = data[:200]
    return data if any(x in head for x in (b"BT", b"Tj", b"TJ")) or re.search(rb"[\x20-\x7e]{20,}", head) else b""


# Text


def is_garbage(text: str) -> bool:
    """As operators.text.is_garbage_text, for one text."""
    readable = sum(map(len, re.findall(r"[a-zA-Z]{2,}|[0-9]{2,}", text)))
    return len(text) >= 5 and readable / len(text) < 0.15


def collapse(text: str) -> str:
    """As operators.text.collapse_letter_spacing, for one text."""
    spaces = text.count(" ")
    others = len(text) - spaces
    if len(text) < 5 or not others or spaces / others < 0.6 or not re.match(r"\s?\S\s\S\s\S", text):
        return text
    return re.sub(r"\s{2,}", " ", re.sub(r"(\S) (?=\S)", r"\1", text)).strip(TRIM)


def decode_text(raw: bytes) -> str:
    """A string's bytes: UTF-16 with a mark or with mostly null high bytes, else UTF-8, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace").strip(TRIM)
    if len(raw) >= 4 and len(raw) % 2 == 0 and raw[::2].count(0) >= 0.7 * len(raw) / 2:
        return raw.decode("utf-16-be", "replace").strip(TRIM)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return collapse(text).strip(TRIM)


def decode_codes(raw: bytes, cmap: dict[bytes, str]) -> str:
    """Codes of a font with a Unicode table; codes that it lacks stand for themselves from space on."""
    if not cmap:
        return decode_text(raw)
    width = max(1, len(next(iter(cmap))))
    codes = (raw[i : i + width] for i in range(0, len(raw), width))
    own = lambda c: chr(int.from_bytes(c)) if 32 <= int.from_bytes(c) < 0x110000 else ""
    return "".join(cmap.get(c, own(c)) for c in codes)


def _hex(x: bytes) -> bytes:
    x = re.sub(rb"[^0-9A-Fa-f]", b"", x)
    return bytes.fromhex((x + b"0" * (len(x) % 2)).decode())


def _target(x: bytes) -> str:
    raw = _hex(x)
    return (chr(int.from_bytes(raw)) if any(raw) else "") if len(raw) <= 2 else raw.decode("utf-16-be", "replace")


def read_cmap(stream: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    one, two = rb"<([0-9A-Fa-f\s]+)>\s*", rb"<([0-9A-Fa-f\s]+)>"
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, text in re.findall(one + two, block):
            out[_hex(code)] = _target(text)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for lo, hi, start, many in re.findall(one + one + rb"(?:" + two + rb"|\[([^\]]*)\])", block):
            width, a, b = len(_hex(lo)), int.from_bytes(_hex(lo)), int.from_bytes(_hex(hi))
            texts = re.findall(two, many)
            for k in range(min(b - a + 1, 65536 if start else len(texts))):
                code = (a + k).to_bytes(width)
                out[code] = _target(b"%0*x" % (len(_hex(start)) * 2, int.from_bytes(_hex(start)) + k)) if start else _target(texts[k])
    return out


ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in round brackets from its first byte on, with nested brackets and escapes, and where it ends."""
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
                continue
            nxt = data[at + 1 : at + 2]
            out.append(b"" if nxt in (b"\n", b"\r") else ESCAPES.get(nxt, nxt))
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


TOKEN = re.compile(rb"[\s\x00]+|%[^\r\n]*|(?P<open>\()|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<dict><<|>>)|(?P<array>[\[\]])|/(?P<name>[^\s/<>\[\]()%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s/<>\[\]()%])|(?P<word>[^\s/<>\[\]()%]+)")


def tokens(data: bytes):
    """(kind, value) of a content stream: text, name, number, array mark or operator."""
    at = 0
    while at < len(data):
        found = TOKEN.match(data, at)
        if not found:
            at += 1
            continue
        at = found.end()
        kind = found.lastgroup
        if kind == "open":
            raw, at = _literal(data, at)
            yield "text", raw
        elif kind == "hex":
            yield "hex", _hex(found["hex"])
        elif kind == "number":
            yield "number", float(found["number"])
        elif kind == "name":
            yield "name", found["name"].decode("latin-1")
        elif kind in ("array", "word"):
            yield kind, found[kind].decode("latin-1")
            if found["word"] == b"ID":  # an inline image's bytes
                end = re.compile(rb"\sEI\b").search(data, at)
                at = end.end() if end else len(data)


def multiply(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def text_segments(stream: bytes, fonts: dict[str, dict[bytes, str]]) -> list[Segment]:
    """Shown strings with the place of their text position on the page, rounded to 0.1.

    Of the text matrix only the translation counts; the transformation matrix counts in full.
    """
    out: list[Segment] = []
    matrix, saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []
    x = y = leading = 0.0
    cmap: dict[bytes, str] = {}
    stack: list[tuple[str, object]] = []

    def show(parts) -> None:
        text = ""
        for kind, v in parts:
            if kind == "number":
                text += " " if v < KERN_SPACE else ""
            elif kind in ("text", "hex"):
                text += decode_codes(v, cmap)
        text = text.strip(TRIM)
        if text:
            out.append((text, round(matrix[0] * x + matrix[2] * y + matrix[4], 1), round(matrix[1] * x + matrix[3] * y + matrix[5], 1)))

    for kind, v in tokens(stream):
        if kind != "word":
            stack.append((kind, v))
            continue
        numbers = [n for k, n in stack if k == "number"]
        if v == "q":
            saved.append(matrix)
        elif v == "Q":
            matrix = saved.pop() if saved else matrix
        elif v == "cm" and len(numbers) >= 6:
            matrix = multiply(tuple(numbers[-6:]), matrix)
        elif v == "BT":
            x = y = 0.0
        elif v == "Tf":
            cmap = fonts.get(next((n for k, n in stack if k == "name"), ""), {})
        elif v == "Tm" and len(numbers) >= 6:
            x, y = numbers[-2:]
        elif v in ("Td", "TD") and len(numbers) >= 2:
            x, y = x + numbers[-2], y + numbers[-1]
            leading = -numbers[-1] if v == "TD" else leading
        elif v == "TL" and numbers:
            leading = numbers[-1]
        elif v == "T*":
            y -= leading
        elif v in ("Tj", "TJ"):
            show(stack)
        elif v in ("'", '"'):
            y -= leading
            show([s for s in stack if s[0] != "number"])
        stack.clear()
    return out


# Pages


def pages(pdf: Pdf) -> list[int]:
    """In the order of the first page list that names them all, else in the order of the file."""
    found = [n for n, raw in pdf.objects.items() if re.search(rb"/Type\s*/Page\b", raw)]
    for raw in pdf.objects.values():
        kids = re.search(rb"/Kids\s*\[([^\]]+)\]", raw) if re.search(rb"/Type\s*/Pages\b", raw) else None
        order = [int(x) for x in REF.findall(kids[1])] if kids else []
        order = [n for n in order if n in set(found)]
        if len(order) == len(found):
            return order
    return found


def _fonts(pdf: Pdf, raw: bytes, cache: dict) -> dict[str, dict[bytes, str]]:
    out = {}
    for name, number in pdf.resource(raw, b"Font").items():
        if number not in cache:
            ref = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", pdf.objects.get(number, b""))
            cache[number] = read_cmap(stream_of(pdf.at(ref))) if ref else {}
        out[name] = cache[number]
    return out


def _streams(pdf: Pdf, number: int, depth: int = 0, seen: frozenset = frozenset()):
    """(object, stream) of a page's contents and of the forms it uses."""
    raw = pdf.objects.get(number, b"")
    if depth > FORM_DEPTH or not raw or number in seen:
        return
    one, many = re.search(rb"/Contents\s+(\d+)\s+\d+\s+R", raw), re.search(rb"/Contents\s*\[([^\]]+)\]", raw)
    sources = [pdf.at(one)] if one else [pdf.objects.get(int(n), b"") for n in REF.findall(many[1])] if many else [raw]
    joined = b"\n".join(stream_of(s) for s in sources if s)
    if joined and not re.search(rb"/Subtype\s*/Image\b", raw):
        yield raw, joined
    for x in dict.fromkeys(pdf.resource(raw, b"XObject").values()):
        yield from _streams(pdf, x, depth + 1, seen | {number})


def _images(pdf: Pdf, raw: bytes, depth: int = 0) -> list[dict]:
    out = []
    for n in dict.fromkeys(pdf.resource(raw, b"XObject").values() if depth <= IMAGE_DEPTH else ()):
        x = pdf.objects.get(n, b"")
        if re.search(rb"/Subtype\s*/Form\b", x):
            out += _images(pdf, x, depth + 1)
        elif re.search(rb"/Subtype\s*/Image\b", x):
            out += _image(x)
    return out


def _image(raw: bytes) -> list[dict]:
    number = lambda key: int((re.search(rb"/" + key + rb"\s+(\d+)", raw) or [0, 0])[1])
    width, height, data = number(b"Width"), number(b"Height"), raw_stream(raw)
    for mark, mime in ((b"/DCTDecode", "image/jpeg"), (b"/JPXDecode", "image/jp2")):
        if mark in raw and data:
            return [m.image_from_data(data, mime) | {"image": m.image_from_data(data, mime)["image"] | {"width": width, "height": height}}]
    plain = inflate(data) if b"/FlateDecode" in raw else None
    space = (re.search(rb"/ColorSpace\s*/(\w+)", raw) or [b"", b"DeviceRGB"])[1]
    png = png_of(plain, width, height, 1 if space == b"DeviceGray" else 4 if space == b"DeviceCMYK" else 3, number(b"BitsPerComponent") or 8) if plain else None
    return [m.image("image.png", width, height, "", png, "image/png")] if png else []


def png_of(data: bytes, width: int, height: int, channels: int, bits: int = 8) -> bytes | None:
    """Raw grey or RGB samples as a PNG; None if their number does not fit."""
    stride = -(-width * channels * bits // 8)
    if channels not in (1, 3) or not width or not height or abs(len(data) - stride * height) > width:
        return None
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + data[y * stride : (y + 1) * stride].ljust(stride, b"\0") for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, bits, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def page_segments(data: bytes):
    """(page, segments, page object) for each page."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s", data):
        raise ValueError("encrypted PDF files are not supported")
    pdf, cache = Pdf(data), {}
    for k, number in enumerate(pages(pdf), 1):
        own = pdf.objects[number]
        base, found = _fonts(pdf, own, cache), []
        for raw, stream in _streams(pdf, number):
            found += text_segments(stream, base | _fonts(pdf, raw, cache))
        yield pdf, k, found, own


def parse_pdf(data: bytes, name: str = "", **_) -> dict:
    made, pdf = [], None
    for pdf, k, segments, raw in page_segments(data):
        made.append(m.section(f"page-{k}", page_elements(segments, is_garbage, collapse) + _images(pdf, raw)))
    pdf = pdf or Pdf(data)
    info, meta = pdf.at(re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)), {}

    def said(key: bytes) -> str:
        found = re.search(rb"/" + key + rb"\s*\(", info)
        return decode_text(_literal(info, found.end())[0]) if found else ""

    meta = {k: said(key) for k, key in (("author", b"Author"), ("creator", b"Creator")) if said(key)}
    return m.document("pdf", said(b"Title") or stem(name), made, meta)
