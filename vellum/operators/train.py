"""Word dictionaries and bigram models as aggregations; each works on a stream as well as on a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

FILE_GLOB = "*.{txt,md,text,csv}"


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of each file: directories with all below them by FILE_GLOB, and files of any extension by name."""
    out = None
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
        reader = spark.read.option("wholetext", True)
        one = (reader.option("recursiveFileLookup", True).option("pathGlobFilter", FILE_GLOB) if folder else reader).text(path)
        one = one.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def dictionary_words(text):
    """Lower-case runs of letters, two at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda w: F.length(w) >= 2)


def ngram_words(text):
    """The same with apostrophes inside words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}']+", -1), lambda w: F.length(w) >= 2)


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq); partial counts before the shuffle."""
    return df.select(F.explode(dictionary_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def merge_counts(old: DataFrame, new: DataFrame, keys=("word",), count: str = "freq") -> DataFrame:
    """Counts added up: training in parts gives what training at once gives."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def filter_by_frequency(words: DataFrame, min_freq: int = 2, min_length: int = 2) -> DataFrame:
    return words.where((F.col("freq") >= min_freq) & (F.length("word") >= min_length))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`word`, or `word<tab>freq`, a line; # begins a comment; frequency 1 by default; a word's last line counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    parts = F.split("v", "\t", 2)
    freq = F.when(F.size(parts) > 1, F.coalesce(F.try_to_number(F.trim(F.get(parts, F.lit(1))), F.lit("999999999999")), F.lit(0))).otherwise(1).cast("long")
    return lines.select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("word"), freq.alias("freq"), "n").groupBy("word").agg(F.max_by("freq", "n").alias("freq"))


def add_words(words: DataFrame, more: dict[str, int]) -> DataFrame:
    """Entries set to the given frequencies."""
    spark = words.sparkSession
    new = spark.createDataFrame([(w.lower(), f) for w, f in more.items()], "word string, freq long")
    return words.join(new.select("word"), "word", "left_anti").unionByName(new)


def save_dictionary(words: DataFrame, path: str) -> None:
    """`word<tab>freq` by falling frequency, in one sorted sequence of part files."""
    words.orderBy(F.desc("freq"), "word").select(F.concat_ws("\t", "word", "freq").alias("value")).write.mode("overwrite").text(path)


def unigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(ngram_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def bigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(w1, w2, freq): neighbours among the kept words of one text, never across texts."""
    ws = df.select(ngram_words(F.col(text_col)).alias("ws"))
    pairs = F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return ws.select(F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(F.count("*").alias("freq"))


class NgramModel:
    """Unigram and bigram counts as tables, and their totals."""

    def __init__(self, uni: DataFrame, bi: DataFrame):
        self.unigrams, self.bigrams = uni, bi

    @classmethod
    def train(cls, df: DataFrame, text_col: str = "text") -> NgramModel:
        """Both counts in one pass over the texts, as a table, so that no later use reads the texts again."""
        ws = df.select(ngram_words(F.col(text_col)).alias("ws"))
        # a unigram is a pair without a second word
        pairs = F.zip_with("ws", F.concat(F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), F.array(F.lit(None).cast("string"))), lambda a, b: F.array(F.struct(a.alias("w1"), F.lit(None).cast("string").alias("w2")), F.struct(a.alias("w1"), b.alias("w2"))))
        both = ws.where(F.size("ws") > 0).select(F.posexplode(F.flatten(pairs)).alias("k", "p")).where("k % 2 = 0 OR p.w2 IS NOT NULL")
        counts = written(both.groupBy("p.w1", "p.w2").agg(F.count("*").alias("freq")), "ngrams")
        return cls(counts.where("w2 IS NULL").select(F.col("w1").alias("word"), "freq"), counts.where("w2 IS NOT NULL"))

    def append(self, other: NgramModel) -> NgramModel:
        return NgramModel(merge_counts(self.unigrams, other.unigrams), merge_counts(self.bigrams, other.bigrams, ("w1", "w2")))

    def stats(self) -> DataFrame:
        """Distinct and total counts, in one row."""
        zero = F.lit(0).cast("long")
        count = lambda df, one: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("freq"), zero).alias("m")).select(*((F.col("n"), zero, F.col("m"), zero) if one else (zero, F.col("n"), zero, F.col("m"))))
        names = ("unique_unigrams", "unique_bigrams", "total_unigrams", "total_bigrams")
        return count(self.unigrams, True).union(count(self.bigrams, False)).toDF(*names).agg(*[F.sum(n).alias(n) for n in names])

    def total(self):
        """All unigram occurrences, as a scalar subquery."""
        return self.unigrams.agg(F.coalesce(F.sum("freq"), F.lit(0))).scalar()

    def score_words(self, words: DataFrame, word: str = "word") -> DataFrame:
        """words with `score`, the word's share of all occurrences; 0 if unknown."""
        counts = self.unigrams.select(F.col("word").alias("_w"), F.col("freq").alias("_n"))
        out = words.withColumn("_low", F.lower(word)).join(counts, F.col("_low") == F.col("_w"), "left")
        return out.select(*words.columns, (F.coalesce("_n", F.lit(0)) / F.greatest(self.total(), F.lit(1))).alias("score"))

    def score_bigrams(self, pairs: DataFrame, w1: str = "w1", w2: str = "w2") -> DataFrame:
        """pairs with `score`, the share of w1's occurrences that w2 follows; 0 if unknown."""
        one = self.unigrams.select(F.col("word").alias("_w"), F.col("freq").alias("_n"))
        two = self.bigrams.select(F.col("w1").alias("_a"), F.col("w2").alias("_b"), F.col("freq").alias("_m"))
        low = pairs.withColumn("_x", F.lower(w1)).withColumn("_y", F.lower(w2))
        out = low.join(one, F.col("_x") == F.col("_w"), "left").join(two, (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")), "left")
        return out.select(*pairs.columns, F.when(F.coalesce("_n", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("_m", F.lit(0)) / F.greatest("_n", F.lit(1))).alias("score"))

    def save(self, path: str) -> None:
        """Tables, for any size."""
        self.unigrams.write.mode("overwrite").parquet(f"{path}/unigrams")
        self.bigrams.write.mode("overwrite").parquet(f"{path}/bigrams")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramModel:
        return cls(spark.read.parquet(f"{path}/unigrams"), spark.read.parquet(f"{path}/bigrams"))

    def export_json(self) -> str:
        """One JSON text for exchange with other programs; the whole model passes the driver, so only for small ones."""
        uni = {r.word: r.freq for r in self.unigrams.orderBy(F.desc("freq"), "word").toLocalIterator()}
        bi = {f"{r.w1} {r.w2}": r.freq for r in self.bigrams.orderBy(F.desc("freq"), "w1", "w2").toLocalIterator()}
        return json.dumps({"unigrams": uni, "bigrams": bi, "totalUnigrams": sum(uni.values()), "totalBigrams": sum(bi.values())}, ensure_ascii=False, indent=4)

    @classmethod
    def import_json(cls, spark: SparkSession, text: str) -> NgramModel:
        data = json.loads(text)
        uni = spark.createDataFrame(list(data.get("unigrams", {}).items()), "word string, freq long")
        bi = spark.createDataFrame([(*k.split(" ", 1), n) for k, n in data.get("bigrams", {}).items()], "w1 string, w2 string, freq long")
        return cls(uni, bi)
