"""What the operators of this subpackage share: shared storage, Arrow helpers and a per-worker cache."""

from __future__ import annotations

import posixpath
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import shared_dir

#: Words of every contract: runs of bytes that are neither a space nor \t \n \v \f \r. `bytes.split()` gives the same.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that operators have made in the shared folder, by application.
SCRATCH: dict[str, list[str]] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear_scratch removes."""
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes what operators have left in the shared folder; to be called when their results are stored elsewhere."""
    paths = SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: df as Parquet in the shared folder, read again. Survives lost executors, unlike a cache."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that only the steps within an operator read; `with` removes them at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
            SCRATCH[self.spark.sparkContext.applicationId].remove(path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        self.paths.append(path)
        return table


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that no name of theirs, dots and repeats included, clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def one_of_each(rows: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """One row for each value of keys, of several always the one whose columns `own` hash least."""
    order = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("none"), *own)))
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over tasks; it must stay bounded."""
    return sys.modules.setdefault("_vellum_worker", types.ModuleType("_vellum_worker")).__dict__


def utf8_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, without decoding; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for fn(batch) -> dict of columns or RecordBatch; schema in DDL."""
    names = [x.name for x in _schema(df.sparkSession, schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def lower_ascii(c):
    """A-Z only, so that no engine's idea of other capitals matters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c):
    """Number of words, all in the JVM; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
