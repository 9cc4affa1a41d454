"""The formats as a Spark data source and a table function.

    register(spark)
    spark.read.format("vellum").load("/folder")                     # documents
    df.write.format("vellum").option("format", "pdf").mode("append").save("/out")
    SELECT * FROM parse_document(path, content)                      # elements, as a lateral table function
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from .. import model as m
from . import PARSERS

#: Files that a partition reads.
FILES_A_PARTITION = 64


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, parsers: dict, schema):
        self.path, self.parsers, self.schema = path, parsers, schema

    def partitions(self):
        from pyarrow import fs

        files, root = filesystem(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(x.path for x in found if x.type == fs.FileType.File and x.extension.lower() in self.parsers)
        return [_Files(paths[k : k + FILES_A_PARTITION]) for k in range(0, len(paths), FILES_A_PARTITION)] or [_Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            extension = path.rpartition(".")[2].lower()
            try:
                with files.open_input_file(path) as f:
                    doc = self.parsers[extension](f.read(), path)
                doc = doc | {"doc_id": path, "source_file": path}
            except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
                doc = m.document(extension, doc_id=path, source_file=path, error=f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_pylist([doc], schema)


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _Writer(DataSourceArrowWriter):
    """Tasks write beside; the driver renames when all are done, and removes what a failed job has left."""

    def __init__(self, path: str, fmt: str):
        self.path, self.fmt = path, fmt

    def write(self, iterator) -> WriterCommitMessage:
        from ..sinks import BINARY

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        moves = []
        for batch in iterator:
            for i in range(batch.num_rows):
                doc = batch.slice(i, 1).to_pylist()[0]
                doc["metadata"] = dict(doc["metadata"] or {})
                name = posixpath.basename(doc["doc_id"] or "document").rsplit(".", 1)[0]
                beside = posixpath.join(root, f".{uuid.uuid4().hex}")
                with files.open_output_stream(beside, compression=None) as f:
                    f.write(BINARY[self.fmt](doc))
                moves.append((beside, posixpath.join(root, f"{name}.{self.fmt}")))
        return _Written(moves)

    def commit(self, messages) -> None:
        files, _ = filesystem(self.path)
        targets = [b for message in messages for _a, b in (message.moves if message else ())]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError(f"several documents would be one file: {next(x for x in targets if targets.count(x) > 1)}")
        for message in messages:
            for a, b in message.moves if message else ():
                files.move(a, b)

    def abort(self, messages) -> None:
        files, _ = filesystem(self.path)
        for message in messages:
            for a, _b in message.moves if message else ():
                files.delete_file(a)


class DocumentSource(DataSource):
    """Documents in and out of a folder; option `format` for writing one of the container formats."""

    @classmethod
    def name(cls) -> str:
        return "vellum"

    def schema(self) -> str:
        return m.DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], dict(PARSERS), schema)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"], self.options.get("format", "pdf"))


class ParseDocument:
    """One row for each element of a file's document."""

    def eval(self, name: str, data: bytes):
        from vellum.sources import parse

        for i, s in enumerate(parse(name, bytes(data or b""))["sections"]):
            for j, e in enumerate(s["elements"]):
                yield i, s["name"], j, e["type"], e["text"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
    spark.udtf.register("parse_document", udtf(ParseDocument, returnType="section_ix int, section string, element_ix int, type string, text string"))
