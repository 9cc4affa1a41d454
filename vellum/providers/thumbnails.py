"""Thumbnails: of images by numpy, of documents from their first image, an embedded preview or a drawn one."""

from __future__ import annotations

import io
import re
import shutil
import struct
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m

WIDTH, HEIGHT = 300, 300
GRID_ROWS, GRID_COLUMNS, GRID_CHARS, TEXT_CHARS, STREAMS = 20, 8, 8, 2000, 5
MIN_SIDE, MIN_BRIGHTNESS, MIN_COLOURS, GRID = 10, 10, 3, 16
MIN_AREA, MIN_JPEG, MIN_PNG = 40_000, 1000, 500
EMBEDDED = ("docProps/thumbnail.jpeg", "docProps/thumbnail.jpg", "docProps/thumbnail.png")
THUMBNAIL = "struct<data:binary,mime_type:string,width:int,height:int>"


def fit(width: int, height: int, most_width: int = WIDTH, most_height: int = HEIGHT) -> tuple[int, int]:
    """The size within the limits that keeps the shape; never larger than it is."""
    ratio = min(most_width / width, most_height / height, 1.0)
    return max(1, round(width * ratio)), max(1, round(height * ratio))


def fit_columns(width, height, most_width: int = WIDTH, most_height: int = HEIGHT):
    """The same as Columns: struct<width, height>."""
    ratio = F.least(F.lit(most_width) / width, F.lit(most_height) / height, F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.round(width * ratio).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * ratio).cast("int")).alias("height"))


def mime_of(data: bytes) -> str:
    for start, mime in ((b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"RIFF", "image/webp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")):
        if data.startswith(start):
            return mime
    return "application/octet-stream"


def image_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:3] == b"\xff\xd8\xff":
        from ..sinks.binary import jpeg_size

        size = jpeg_size(data)
        return size[:2] if size else None
    return None


def decode_png(data: bytes) -> np.ndarray | None:
    """RGB samples of an 8-bit PNG without interlacing; None for other images."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if bits != 8 or interlaced or not channels:
        return None
    body, palette, at = b"", None, 8
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        elif data[at + 4 : at + 8] == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3)
        at += 12 + n
    raw = zlib.decompress(body)
    stride = w * channels
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.int64)
    for y in range(h):
        kind_of_row = raw[y * (stride + 1)]
        row = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind_of_row == 1:
            row = np.cumsum(row.reshape(w, channels), axis=0).reshape(-1)
        elif kind_of_row == 2:
            row = row + before
        elif kind_of_row in (3, 4):
            row = row.copy()
            for x in range(stride):
                a, b = (row[x - channels] if x >= channels else 0), before[x]
                if kind_of_row == 3:
                    row[x] = (row[x] + (a + b) // 2) & 255
                else:
                    c = before[x - channels] if x >= channels else 0
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                    row[x] = (row[x] + near[2]) & 255
        before = row & 255
        out[y] = before
    pixels = out.reshape(h, w, channels)
    if kind == 3:
        return palette[pixels[..., 0]] if palette is not None else None
    return np.repeat(pixels[..., :1], 3, axis=2) if channels <= 2 else pixels[..., :3]


def encode_png(pixels: np.ndarray) -> bytes:
    from ..sources.pdf import png_of

    h, w, _ = pixels.shape
    return png_of(np.ascontiguousarray(pixels, np.uint8).tobytes(), w, h, 3)


def resize(data: bytes, most_width: int = WIDTH, most_height: int = HEIGHT) -> dict | None:
    """A smaller PNG of an image; the image itself if it is small enough; None if it cannot be read here."""
    size = image_size(data)
    if not size:
        return None
    if size[0] <= most_width and size[1] <= most_height:
        return {"data": data, "mime_type": mime_of(data), "width": size[0], "height": size[1]}
    pixels = decode_png(data)
    return shrink(pixels, most_width, most_height) if pixels is not None else None


def shrink(pixels: np.ndarray, most_width: int, most_height: int) -> dict:
    h, w, _ = pixels.shape
    nw, nh = fit(w, h, most_width, most_height)
    # mean over the source pixels of each target pixel, by sums up to each edge
    total = np.zeros((h + 1, w + 1, 3))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    ys, xs = np.linspace(0, h, nh + 1).astype(int), np.linspace(0, w, nw + 1).astype(int)
    area = np.diff(ys)[:, None, None] * np.diff(xs)[None, :, None]
    sums = total[ys[1:]][:, xs[1:]] - total[ys[:-1]][:, xs[1:]] - total[ys[1:]][:, xs[:-1]] + total[ys[:-1]][:, xs[:-1]]
    return {"data": encode_png(np.round(sums / np.maximum(1, area)).astype(np.uint8)), "mime_type": "image/png", "width": nw, "height": nh}


def usable(data: bytes) -> bool:
    """At least 10 by 10, of three colours and not black, by an even grid of points; an image that is not decoded here is judged by its size."""
    pixels = decode_png(data)
    if pixels is None:
        size = image_size(data)
        return bool(size) and min(size) >= MIN_SIDE
    h, w, _ = pixels.shape
    if min(h, w) < MIN_SIDE:
        return False
    # points in the middle of the cells of a grid, each image's sides cut alike; colours by eighths of each channel
    rows, columns = (((np.arange(k := min(GRID, n)) + 0.5) * n / k).astype(int) for n in (h, w))
    points = pixels[np.ix_(rows, columns)].reshape(-1, pixels.shape[2])
    colours = {tuple(c) for c in (points // 32).tolist()}
    return len(colours) >= MIN_COLOURS and float(points.mean()) >= MIN_BRIGHTNESS


def largest_embedded(data: bytes) -> bytes | None:
    """Of the JPEG and PNG images within a file's bytes the one of the largest area, if any is large enough."""
    found = [x for p, least in ((rb"\xff\xd8\xff.*?\xff\xd9", MIN_JPEG), (rb"\x89PNG\r\n\x1a\n.*?IEND.{4}", MIN_PNG)) for x in re.findall(p, data, re.S) if len(x) >= least]
    sized = [(s[0] * s[1], x) for x in found if (s := image_size(x)) and s[0] * s[1] >= MIN_AREA]
    return max(sized, key=lambda s: s[0])[1] if sized else None


def package_thumbnail(data: bytes) -> bytes | None:
    """The preview that an office package holds, at the usual places or by its relationships."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names, rels = z.namelist(), b""
            if "_rels/.rels" in names:
                rels = z.read("_rels/.rels")
            said = [x.decode().lstrip("/") for r in re.findall(rb"<Relationship\b[^>]*thumbnail[^>]*>", rels) for x in re.findall(rb'Target="([^"]+)"', r)]
            return next((x for n in (*EMBEDDED, *said) if n in names and usable(x := z.read(n))), None)
    except (zipfile.BadZipFile, KeyError):
        return None


def preview_text(data: bytes) -> str:
    """Text of the first page's streams of a PDF, without positions; at most TEXT_CHARS characters."""
    from ..sources.pdf import Pdf, page_segments, stream_of, text_segments

    try:
        texts = [t for _, k, found, _ in page_segments(data) if k == 1 for t, _, _ in found]
    except ValueError:
        return ""
    if not texts:
        pdf = Pdf(data)
        texts = [t for raw in list(pdf.objects.values())[: 20 * STREAMS] if (s := stream_of(raw)) and b"BT" in s for t, _, _ in text_segments(s, {})]
    return "\n".join(texts)[:TEXT_CHARS]


def preview_cells(doc: dict) -> list[list[str]]:
    """The first rows and columns of a document's first table, cells cut; lines of text without a table."""
    for s in doc["sections"]:
        for e in s["elements"]:
            if e["type"] == "table":
                return [[(c["text"] or "")[:GRID_CHARS] for c in r["cells"][:GRID_COLUMNS]] for r in e["table"]["rows"][:GRID_ROWS]]
    return [[(e["text"] or "")[: GRID_CHARS * GRID_COLUMNS]] for s in doc["sections"] for e in s["elements"] if e["type"] == "paragraph"][:GRID_ROWS]


def draw(doc: dict, width: int = WIDTH, height: int = HEIGHT) -> dict:
    """A page with a bar for each word-like run of the preview's cells, headings and header rows darker."""
    page = np.full((height, width, 3), 255, np.uint8)
    rows = preview_cells(doc)
    columns = max((len(r) for r in rows), default=1)
    step, wide = max(6, height // (GRID_ROWS + 1)), max(8, (width - 16) // max(1, columns))
    table = columns > 1
    for i, row in enumerate(rows):
        top = 8 + i * step
        if top + step > height:
            break
        shade = (55, 65, 81) if i == 0 else (107, 114, 128)
        for j, text in enumerate(row):
            left = 8 + j * wide
            if table:
                page[top - 2 : top + step - 2, left : left + 1] = (209, 213, 219)
            share = min(1.0, len(text) / (GRID_CHARS if table else GRID_CHARS * GRID_COLUMNS))
            page[top : top + step // 2, left + 3 : left + 3 + int((wide - 8) * share)] = shade
        if table:
            page[top + step - 2 : top + step - 1, 8 : 8 + wide * columns] = (209, 213, 219)
    return {"data": encode_png(page), "mime_type": "image/png", "width": width, "height": height}


def capabilities() -> dict[str, bool]:
    return {"png": True, "jpeg_pass": True, "pdf_native": True, "ghostscript": bool(shutil.which("gs")), "libreoffice": bool(shutil.which("soffice") or shutil.which("libreoffice"))}


def by_ghostscript(data: bytes, timeout: float = 60) -> bytes | None:
    """The first page of a PDF at 150 dots an inch, if Ghostscript is there."""
    if not shutil.which("gs"):
        return None
    with tempfile.TemporaryDirectory() as d:
        (Path(d) / "in.pdf").write_bytes(data)
        done = subprocess.run(["gs", "-q", "-dSAFER", "-dBATCH", "-dNOPAUSE", "-sDEVICE=png16m", "-r150", "-dFirstPage=1", "-dLastPage=1", f"-sOutputFile={d}/out.png", f"{d}/in.pdf"], capture_output=True, timeout=timeout, check=False)
        out = Path(d) / "out.png"
        return out.read_bytes() if done.returncode == 0 and out.exists() else None


def by_libreoffice(name: str, data: bytes, timeout: float = 120) -> bytes | None:
    """The first page of an office file as LibreOffice draws it, if it is there."""
    program = shutil.which("soffice") or shutil.which("libreoffice")
    if not program:
        return None
    with tempfile.TemporaryDirectory() as d:
        source = Path(d) / f"in.{name.rpartition('.')[2]}"
        source.write_bytes(data)
        done = subprocess.run([program, "--headless", f"-env:UserInstallation=file://{d}/profile", "--convert-to", "png", "--outdir", d, str(source)], capture_output=True, timeout=timeout, check=False)
        out = Path(d) / "in.png"
        return out.read_bytes() if done.returncode == 0 and out.exists() else None


def of_file(name: str, data: bytes, most_width: int = WIDTH, most_height: int = HEIGHT) -> dict | None:
    """A file's thumbnail: an image resized; a PDF's rendered page, largest image or drawn text; a package's own preview;
    else a drawn one."""
    from ..sources import PARSERS, parse

    extension = name.rpartition(".")[2].lower()
    if mime_of(data).startswith("image/"):
        return resize(data, most_width, most_height)
    own = None
    if extension == "pdf":
        own = by_ghostscript(data) or largest_embedded(data)
    elif extension in m.OFFICE or extension == "csv":
        own = (package_thumbnail(data) if extension in ("docx", "xlsx", "pptx") else None) or by_libreoffice(name, data)
    made = resize(own, most_width, most_height) if own else None
    if made:
        return made
    if extension == "pdf":
        text = preview_text(data)
        return draw(m.document("pdf", sections=[m.section("", [m.paragraph(x) for x in text.split("\n")])]), most_width, most_height) if text else None
    if extension not in PARSERS:
        return None
    try:
        return draw(parse(name, data), most_width, most_height)
    except (ValueError, zipfile.BadZipFile):
        return None


def thumbnails(files: DataFrame, name_col: str = "path", data_col: str = "content", most_width: int = WIDTH, most_height: int = HEIGHT) -> DataFrame:
    """(doc_id, thumbnail struct or null) for files."""
    kind = pa.struct([("data", pa.binary()), ("mime_type", pa.string()), ("width", pa.int32()), ("height", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([of_file(name, data, most_width, most_height)], kind)], names=["doc_id", "thumbnail"])

    return files.select(F.col(name_col).cast("string"), F.col(data_col).cast("binary")).mapInArrow(run, f"doc_id string, thumbnail {THUMBNAIL}")


def of_documents(df: DataFrame, most_width: int = WIDTH, most_height: int = HEIGHT) -> DataFrame:
    """(doc_id, thumbnail) of documents: their first image made small, else a drawn preview."""
    kind = pa.struct([("data", pa.binary()), ("mime_type", pa.string()), ("width", pa.int32()), ("height", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc = batch.slice(i, 1).to_pylist()[0]
                pictures = (e["image"]["data"] for s in doc["sections"] or [] for e in s["elements"] or [] if e["type"] == "image" and e["image"]["data"])
                made = next((x for p in pictures if (x := resize(p, most_width, most_height))), None) or draw(doc, most_width, most_height)
                yield pa.RecordBatch.from_arrays([pa.array([doc["doc_id"]], pa.string()), pa.array([made], kind)], names=["doc_id", "thumbnail"])

    return df.mapInArrow(run, f"doc_id string, thumbnail {THUMBNAIL}")


def data_uri(thumbnail):
    return F.when(thumbnail.isNotNull(), F.concat(F.lit("data:"), thumbnail["mime_type"], F.lit(";base64,"), F.base64(thumbnail["data"])))
