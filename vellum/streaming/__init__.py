"""The counting and cleaning operators on streams: the same functions, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import text, train

parse_stream = sources.read_stream
#: Counts are sums, so on a stream of texts these are tables that grow; output mode update or complete.
dictionary = train.dictionary
unigrams = train.unigrams
bigrams = train.bigrams


def cleaned(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless: noise off, confusions mended, language found."""
    df = stream.withColumn(text_col, text.clean_ocr_noise(F.col(text_col)))
    return df.withColumn(text_col, text.fix_confusions(F.col(text_col))).withColumn("language", text.detect_language(F.col(text_col)))


def windowed_words(stream: DataFrame, time_col: str, text_col: str = "text", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, word, freq) of event-time windows; rows later than `late` are left out, so state stays bounded."""
    words = stream.withWatermark(time_col, late).select(F.col(time_col).alias("_t"), F.explode(train.dictionary_words(F.col(text_col))).alias("word"))
    return words.groupBy(F.window("_t", width).alias("window"), "word").agg(F.count("*").alias("freq"))


def keep_dictionary(stream: DataFrame, table_path: str, checkpoint: str, text_col: str = "text"):
    """Writes each batch's counts as a part of a table keyed by batch, so that a repeated batch overwrites its own part.

    The dictionary at any time is the sum over parts (`dictionary_of`); a batch never rewrites what others have counted.
    """

    def put(batch: DataFrame, number: int) -> None:
        train.dictionary(batch, text_col).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def dictionary_of(spark, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path).groupBy("word").agg(F.sum("freq").alias("freq"))
