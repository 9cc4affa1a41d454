"""Rendering documents to ten formats: text formats in the JVM, containers by Arrow functions; all narrow, no shuffle."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binary, text

#: Format to renderer: of text formats a function that gives a Column, of the others one from a document's dict to bytes.
TEXT: dict[str, Callable] = {
    "csv": text.render_csv,
    "md": text.render_markdown,
    "markdown": text.render_markdown,
    "html": text.render_html,
}
BINARY: dict[str, Callable[[dict], bytes]] = {
    "pdf": binary.render_pdf,
    "docx": binary.render_docx,
    "doc": binary.render_doc,
    "xlsx": binary.render_xlsx,
    "xls": binary.render_xls,
    "pptx": binary.render_pptx,
    "ppt": binary.render_ppt,
}


def register_renderer(fmt: str, renderer: Callable[[dict], bytes]) -> None:
    """A renderer from a document's dict to bytes for one more format, or in place of the one there is."""
    TEXT.pop(fmt.lower(), None)
    BINARY[fmt.lower()] = renderer


def supported_formats() -> list[str]:
    return [*TEXT, *BINARY]


def render(df: DataFrame, fmt: str, **options) -> DataFrame:
    """(doc_id, content): the documents in a format, content as bytes. Options go to the text formats' renderers."""
    fmt = fmt.lower()
    if fmt in TEXT:
        return df.select("doc_id", F.encode(TEXT[fmt](**options), "UTF-8").alias("content"))
    if fmt not in BINARY:
        raise ValueError(f"no renderer for {fmt}")
    renderer = BINARY[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a row holds a whole document
                doc = batch.slice(i, 1).to_pylist()[0]
                doc["metadata"] = dict(doc["metadata"] or {})
                yield pa.RecordBatch.from_arrays([pa.array([doc["doc_id"]], pa.string()), pa.array([renderer(doc)], pa.binary())], names=["doc_id", "content"])

    return df.mapInArrow(run, "doc_id string, content binary")


def target_of(doc_id: str | None, extension: str, base: str | None = None) -> str:
    """A document's file below the folder: its path below base (its name alone, if it does not lie there) with the extension."""
    bare = lambda p: re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "/", p)  # noqa: E731 - without scheme
    path, top = bare(doc_id or "document"), bare(base).rstrip("/") + "/" if base else None
    path = path[len(top) :] if top and path.startswith(top) else posixpath.basename(path)
    name, stem = posixpath.split(path)
    return posixpath.join(name, f"{stem.rsplit('.', 1)[0]}.{extension}")


def check_targets(doc_ids: DataFrame, extension: str, base: str | None = None) -> None:
    """Raises where two of doc_ids(doc_id) would be written to one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([target_of(x, extension, base) for x in batch.column(0).to_pylist()], pa.string())], names=["doc_id", "target"])

    targets = doc_ids.select("doc_id").distinct().mapInArrow(run, "doc_id string, target string")
    twice = targets.groupBy("target").agg(F.count("*").alias("n"), F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError("several documents would be one file: " + "; ".join(f"{r.one} and {r.other} as {r.target}" for r in twice))


def save(df: DataFrame, folder: str, fmt: str, base: str | None = None, check: bool = True, **options) -> DataFrame:
    """Writes a file for each document into a folder that all executors see, and returns (doc_id, path).

    A file's path below the folder is that of its document below `base`. Documents that would be written to one file are an
    error before anything is written (check=False leaves that look out, where names are known to differ). Files appear under
    their name only when whole: each attempt writes beside and renames. The folder may be any URI that pyarrow's file systems know.
    """
    extension = {"markdown": "md"}.get(fmt.lower(), fmt.lower())
    if check:
        check_targets(df, extension, base)
    content = render(df, fmt, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = posixpath.join(root, target_of(doc_id, extension, base))
                files.create_dir(posixpath.dirname(path), recursive=True)
                beside = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(beside, compression=None) as f:
                    f.write(data)
                files.move(beside, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return content.mapInArrow(run, "doc_id string, path string")
