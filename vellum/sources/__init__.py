"""Reading files of ten formats into the document model, in batch and as a stream.

Files come through Spark's binaryFile reader, so any store that Spark reads will do; a parser is a pure function of
(bytes, name, options), chosen by the extension. A file that cannot be parsed gives a row with `error` set.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model as m
from . import legacy, markup, ooxml, pdf

Parser = Callable[..., dict]

#: Extension to parser.
PARSERS: dict[str, Parser] = {
    **dict.fromkeys(("html", "htm"), markup.parse_html),
    **dict.fromkeys(("csv", "tsv"), markup.parse_csv),
    "docx": ooxml.parse_docx,
    "doc": legacy.parse_doc,
    "pdf": pdf.parse_pdf,
    **dict.fromkeys(("md", "markdown", "mkd", "mdown"), markup.parse_markdown),
    "xlsx": ooxml.parse_xlsx,
    "xls": legacy.parse_xls,
    "pptx": ooxml.parse_pptx,
    "ppt": legacy.parse_ppt,
}


def register_parser(extension: str, parser: Parser) -> None:
    """A parser for one more extension, or in place of the one there is."""
    PARSERS[extension.lower().lstrip(".")] = parser


def supported_extensions() -> list[str]:
    return list(PARSERS)


def parse(name: str, data: bytes, **options) -> dict:
    """One file's document; raises ValueError for an extension without a parser."""
    extension = name.rpartition(".")[2].lower()
    if extension not in PARSERS:
        raise ValueError(f"no parser for .{extension}")
    return PARSERS[extension](data, name, **options) | {"doc_id": name, "source_file": name}


#: Documents go to Spark in batches of at most so many, or of what so many bytes of files have given.
BATCH_DOCS, BATCH_BYTES = 500, 1 << 18
#: New objects after which Python looks for cycles among them: a batch's documents live until it ends, and are not looked through again and again.
NEW_OBJECTS = 100_000


def parse_files(files: DataFrame, name_col: str = "path", data_col: str = "content", **options) -> DataFrame:
    """Documents of files(name, bytes): narrow, no shuffle; small files share a batch, a file over BATCH_BYTES ends one."""
    schema = to_arrow_schema(m.schema())
    parsers = dict(PARSERS)
    most_docs, most_bytes, new_objects = BATCH_DOCS, BATCH_BYTES, NEW_OBJECTS

    def failed(name: str | None, e: Exception) -> dict:
        return m.document((name or "").rpartition(".")[2].lower(), doc_id=name, source_file=name, error=f"{type(e).__name__}: {e}")

    def parsed(name: str | None, data: bytes) -> dict:
        extension = (name or "").rpartition(".")[2].lower()
        try:
            if extension not in parsers:
                raise ValueError(f"no parser for .{extension}")
            return parsers[extension](data, name or "", **options) | {"doc_id": name, "source_file": name}
        except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
            return failed(name, e)

    def made(docs: list[dict]) -> Iterator[pa.RecordBatch]:
        try:
            yield pa.RecordBatch.from_pylist(docs, schema)
        except Exception as e:  # noqa: BLE001 - nor is one that does not fit the schema, nor the end of its neighbours
            if len(docs) == 1:
                yield pa.RecordBatch.from_pylist([failed(docs[0]["doc_id"], e)], schema)
            else:
                for doc in docs:
                    yield from made([doc])

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(parsed(name, data or b""))
                size += len(data or b"")
                if len(docs) >= most_docs or size >= most_bytes:
                    yield from made(docs)
                    docs, size = [], 0
        if docs:
            yield from made(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = gc.get_threshold()
        gc.set_threshold(new_objects, *usual[1:])
        try:
            yield from batched(batches)
        finally:
            gc.set_threshold(*usual)

    return files.select(F.col(name_col).cast("string").alias("name"), F.col(data_col).cast("binary").alias("data")).mapInArrow(run, m.DOCUMENT)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out over four tasks a core where they come in fewer: for narrow rows that cost much each.

    A small file is a task or two however many rows it has. Rows that come in as many tasks or more stay where they are.
    """
    wanted = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


def files_of(spark: SparkSession, *paths: str) -> DataFrame:
    """Spark's rows of files and folders (with all below them): path, modificationTime, length, content."""
    glob = "*.{" + ",".join(PARSERS) + "}"
    out = None
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
        reader = spark.read.format("binaryFile")
        files = (reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob) if folder else reader).load(path)
        out = files if out is None else out.unionByName(files)
    return out


def read(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Documents of files and folders (with all below them)."""
    return parse_files(files_of(spark, *paths), **options)


def read_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Documents of the files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    glob = "*.{" + ",".join(PARSERS) + "}"
    return parse_files(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder), **options)


def pdf_segments(files: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """(doc_id, page, seg_ix, text, x, y): the positioned strings of PDF files, before any layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"doc_id": name, "page": k, "seg_ix": i, "text": t, "x": x, "y": y} for _, k, found, _ in pdf.page_segments(data) for i, (t, x, y) in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("seg_ix", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64())]))

    return files.select(F.col(name_col).cast("string"), F.col(data_col).cast("binary")).mapInArrow(run, "doc_id string, page int, seg_ix int, text string, x double, y double")
