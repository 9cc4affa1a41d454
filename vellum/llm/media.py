"""Operator 2: content-addressed media payloads in tar shards.

`store` packs each distinct payload once, in the tar shard of the task that owns it, under the name `<sha256>.png`; a row
carries the digest, the shard, the offset and the length, never the bytes. `fill_metadata` reads only the first 33 bytes of an
entry (signature and IHDR) to fill the metadata columns, and `read_payloads` reads the entry's range and decodes it.

A payload is the text's UTF-8, padded with spaces to a positive multiple of 192 bytes, as the 8-bit grey samples of a
PNG that is 192 wide: lossless, and its header tells width, height and depth.

Only digests are shuffled, never texts. A first pass finds each row's digest and the number of its partition; of the partitions
that hold a payload the least owns it. The partitions' lists go to the shared folder as files, where the second pass reads its
own, encodes what it owns and writes it. Should the second pass be dealt out differently (say, other executors since), payloads
remain that nobody stored; they are dealt out again until none is left.

Shards lie in the shared folder; an attempt writes a file of its own name and only its rows point there, so a lost
executor costs a repeat of its tasks; files that no row points to are removed at the end.

Cases: null is an empty text, whose payload is 192 spaces; texts of any length are whole; equal texts have one entry;
an empty table gives an empty result; other input columns are not touched.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, utf8_values, written

WIDTH, BLOCK = 192, 512
#: Partitions whose lists of payloads share a folder, and bytes of media that a task reads back.
LISTS, READ_BYTES = 64, 32 << 20
#: Times that payloads which nobody stored are dealt out.
ROUNDS = 5
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (WIDTH if not text else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> dict:
    """Metadata from the first HEADER_BYTES bytes alone."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG entry")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "color_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG as encode_png makes it; every chunk's checksum is verified."""
    head, at, packed = png_header(data[:HEADER_BYTES]), 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head["height"], head["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def _filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def payload_digest(text: Column) -> Column:
    """SHA-256 of a text's payload, in the JVM."""
    whole = F.coalesce(text, F.lit(""))
    size = F.octet_length(whole)
    spaces = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH))).cast("int")
    return F.unhex(F.sha2(F.concat(whole, F.repeat(F.lit(" "), spaces)).cast("binary"), 256))


def digests(texts: DataFrame) -> DataFrame:
    """id, n_bytes, digest (of the payload) and part (the row's partition) of texts(id, text)."""
    return texts.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), payload_digest(F.col("text")).alias("digest"), F.spark_partition_id().alias("part"))


def owned(lists: str, part: int) -> set[bytes]:
    """The digests that a partition shall store, from its list in the shared folder."""
    from pyarrow import fs, parquet

    files, folder = _filesystem(posixpath.join(lists, f"folder={part // LISTS}"))
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return set()
    names = sorted(x.path for x in files.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet"))
    return {x for n in names for x in parquet.read_table(n, filesystem=files, columns=["digest"], filters=[("part", "=", part)], partitioning=None, use_threads=False, pre_buffer=False)["digest"].to_pylist()}


def write_owned(texts: DataFrame, root: str, lists: str) -> DataFrame:
    """Writes shards under root as a side effect of its tasks; rows: digest, shard, offset, length of what each partition owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine, sink, at, shard = None, None, 0, f"{part:07d}-{uuid.uuid4().hex}.tar"
        for batch in batches:
            mine, rows = owned(lists, part) if mine is None else mine, []
            for text in utf8_values(batch.column(1)) if mine else ():
                payload = pad(text)
                digest = hashlib.sha256(payload).digest()
                if digest in mine:
                    mine.remove(digest)
                    if sink is None:
                        files, folder = _filesystem(root)
                        files.create_dir(folder, recursive=True)
                        sink = files.open_output_stream(posixpath.join(folder, shard), compression=None)
                    media = encode_png(payload)
                    sink.write(tar_header(f"{digest.hex()}.png", len(media)))
                    sink.write(media)
                    sink.write(b"\0" * (-len(media) % BLOCK))
                    rows.append((digest, shard, at + BLOCK, len(media)))
                    at += BLOCK + len(media) + -len(media) % BLOCK
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
        if sink is not None:
            sink.write(b"\0" * (2 * BLOCK))
            sink.close()

    return texts.mapInArrow(run, "digest binary, shard string, offset long, length long")


def store(df: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, entries): id, n_bytes and digest of each row; digest, shard, offset and length of each distinct payload."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))  # the same columns in both passes, so that both are dealt out alike
    rows, _ = written(digests(texts), "media-rows")
    todo, entries = rows, None
    with Scratch(spark) as scratch:
        for _ in range(ROUNDS):
            owners = todo.groupBy("digest").agg(F.min("part").alias("part")).withColumn("folder", F.floor(F.col("part") / LISTS))
            lists = fresh(spark, "media-lists")
            scratch.paths.append(lists)
            owners.repartition("folder").write.partitionBy("folder").parquet(lists)
            made, _ = written(write_owned(texts, root, lists), "media-entries")
            entries = made if entries is None else entries.unionByName(made)
            left = rows.select("digest").distinct().join(entries, "digest", "left_anti")
            if not left.limit(1).count():
                break
            # what is left becomes a table, which the next passes read alike
            texts = scratch.written(texts.withColumn("digest", payload_digest(F.col("text"))).join(left, "digest", "left_semi").select("id", "text"), "media-left")
            todo = digests(texts)
        else:
            raise ValueError("the partitions of the input change from one pass to the next")
    # an attempt that was lost may have left a file; at most one name for each task comes to the driver
    named = {r.shard for r in entries.select("shard").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in files.listStatus(folder) if files.exists(folder) else []:
        if x.getPath().getName() not in named:
            files.delete(x.getPath(), False)
    return rows.select(F.col("id").alias(id_col), "n_bytes", "digest"), entries


def addressed(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows with the address of their payload."""
    return rows.join(entries, "digest")


class _Shards:
    """The open shards of a task; one at a time, as the index is in shard order within its files."""

    def __init__(self, root: str):
        self.files, self.folder = _filesystem(root)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.files.open_input_file(posixpath.join(self.folder, shard))
        return self.file.read_at(length, offset)


def by_address(entries: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """entries dealt out by address, about read_bytes of media to a task, so that a task reads few shards, each forwards."""
    total = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // read_bytes))
    return entries.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def fill_metadata(entries: DataFrame, root: str) -> DataFrame:
    """entries with width, height, bit_depth and color_type, from range reads of the entries' headers only."""
    names = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root)
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n in ("shard", "offset")}
            heads = [png_header(shards.read(s, o, HEADER_BYTES)) for s, o in zip(col["shard"], col["offset"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "bit_depth", "color_type"))], names=[*names, "width", "height", "bit_depth", "color_type"])

    return entries.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields) + ", width int, height int, bit_depth int, color_type int")


def feature_of(payload: bytes, head: dict) -> str:
    """Statistics of the samples: size, mean, spread, and the shares of eight sample ranges in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = int((counts * values).sum()) / samples.size
    spread = (int((counts * values * values).sum()) / samples.size - mean * mean) ** 0.5
    shares = (counts.reshape(8, 32).sum(axis=1) * 1000 // samples.size).tolist()
    return f"{head['width']}x{head['height']}x{head['bit_depth']};mean={mean:.3f};std={spread:.3f};hist={','.join(map(str, shares))}"


def read_payloads(entries: DataFrame, root: str) -> DataFrame:
    """Reads every entry back, once, verifies it against its digest, and computes digests and the feature from the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root)
        for batch in batches:
            rows = []
            for digest, shard, offset, length, width, height, depth in zip(*(x.to_pylist() for x in batch.columns)):
                media = shards.read(shard, offset, length)
                payload = decode_png(media)
                found = hashlib.sha256(payload).digest()
                if found != digest:
                    raise ValueError(f"{shard}@{offset}: the payload is not the one stored")
                rows.append((len(payload), found.hex(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, {"width": width, "height": height, "bit_depth": depth})))
            size, sha, crc, media_size, media_sha, feature = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(media_size, pa.int64()), pa.array(media_sha, pa.string()), pa.array(feature, pa.string())], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    cut = entries.select("digest", "shard", "offset", "length", "width", "height", "bit_depth")
    return cut.mapInArrow(run, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_entry(root: str, shard: str, offset: int, length: int) -> bytes:
    """One payload by its address."""
    return decode_png(_Shards(root).read(shard, offset, length))


def as_tar(root: str, shard: str) -> tarfile.TarFile:
    """A shard as an ordinary tar file (tests, export)."""
    files, folder = _filesystem(root)
    with files.open_input_file(posixpath.join(folder, shard)) as f:
        return tarfile.open(fileobj=io.BytesIO(f.read()))


def op2_media_tar(spark, sf_dir) -> DataFrame:
    root = f"{fresh(spark, 'media')}/shards"
    rows, entries = store(table(spark, sf_dir, "documents"), root)
    # each entry is read once, however many rows point to it; a table, so that a payload that many rows share can be split in the join
    # the headers' columns are a table as well: two chained Python functions would take two workers for each core
    with Scratch(spark) as scratch:
        headed = scratch.written(fill_metadata(by_address(entries), root), "media-headed")
        found, _ = written(read_payloads(by_address(headed), root), "media-features")
    return rows.join(found, "digest").drop("digest")
