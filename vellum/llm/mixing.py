"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document draws an exponential key with its quality weight as the rate, from a hash of its id and text, so reruns
agree. Within a source documents come in the order of their keys; complete epochs take every document once each, and what
remains of the target goes to the documents in that order while the running sum of sizes stays within it (the document on
the border is taken if that comes nearer).

The running sum has two levels, so no source needs to fit one task: keys are dealt into buckets whose number follows the
source's size, sums of buckets give the bucket in which the target is met, and only that bucket is put in order.

Cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are taken in name only
(0 words); ties of keys are broken by id, then text hash; repeated rows (same id and text) share a key and follow each other;
an empty table gives an empty result; a table without words has targets of 0; more than MAX_SOURCES sources are an error; other
input columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, word_count, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20240601
#: Documents that a bucket of keys should hold.
BUCKET_DOCS = 4000
#: Targets are found in one task, with a row for each source; more sources than this are refused, not cut.
MAX_SOURCES = 1_000_000
SYMBOLS = "#*$%&|<>"
#: Quality weights, the rates of the exponential keys.
CLASSES = (4.0, 2.0, 1.0)


def quality_weight(text: Column) -> Column:
    """One of CLASSES: less for texts with many symbols."""
    whole = F.coalesce(text, F.lit(""))
    share = 1 - F.length(F.translate(whole, SYMBOLS, "")) / F.greatest(F.lit(1), F.length(whole))
    return F.when(share <= 0.01, 4.0).when(share <= 0.05, 2.0).otherwise(1.0)


def uniform(*columns: Column) -> Column:
    """In (0, 1), the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target for sizes(source, source_size, ...), one row per source, with its other columns.

    Shares by weight, capped at most times the size and the excess reshared, have a closed form: in the order of
    cap / weight, sources are full until one is not; all after it get the same rate.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    all_of = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("rate", (share * F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("full", F.col("cap") <= F.col("rate") * F.col("w"))
    # the first that is not full has the highest rate of those that are not
    t = t.withColumn("common", F.max(F.when(~F.col("full"), F.col("rate"))).over(all_of))
    return t.select(*sizes.columns, F.when(F.col("full"), F.col("cap")).otherwise(F.col("common") * F.col("w")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """id, text_hash, source, size, source_size, target, copies and taken (copies * size) for each row of df."""
    text = F.col(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), uniform(F.col(id_col).cast("string"), text).alias("u"), quality_weight(text).alias("q"))
    docs, _ = written(docs.select("id", "text_hash", "source", "size", "q", (-F.log("u") / F.col("q")).alias("key")), "mix-sizes")
    same = F.col("source").eqNullSafe(F.col("s"))
    by_class = [F.avg((F.col("q") == w).cast("double")).alias(f"share{k}") for k, w in enumerate(CLASSES)]
    goal = targets(docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), *by_class), weights, share, most)
    goal, _ = written(goal, "mix-sources")
    if (n := goal.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; targets are for at most {MAX_SOURCES}, so group them first")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal, _ = written(goal.withColumn("buckets", F.ceil(F.col("n") / bucket_docs).cast("long")).withColumnRenamed("source", "s"), "mix-targets")
    # the keys' own distribution function in the source, so that buckets are even whatever the mixture of qualities
    upto_key = sum(F.col(f"share{k}") * (1 - F.exp(-w * F.col("key"))) for k, w in enumerate(CLASSES))
    bucket = F.least(F.floor(upto_key * F.col("buckets")).cast("long"), F.col("buckets") - 1)
    dealt = docs.join(goal, same).withColumn("bucket", bucket)
    sums = dealt.groupBy("s", "rest", "bucket").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    border = sums.where("before < rest AND before + words >= rest").groupBy("s").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("x")).select(F.col("s").alias("s2"), F.col("x.bucket").alias("border"), F.col("x.before").alias("before"))
    goal, _ = written(goal.join(border, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-borders")
    dealt = docs.join(goal, same).withColumn("bucket", bucket)
    # without a border nothing remains, or rounding left the target beyond the last sum: then all are taken
    plain = dealt.withColumn("more", F.when(F.col("rest") <= 0, 0).when(F.col("border").isNull(), 1).when(F.col("bucket") < F.col("border"), 1).when(F.col("bucket") > F.col("border"), 0))
    run = W.partitionBy("s").orderBy("key", "id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    edge = plain.where("more IS NULL").withColumn("upto", F.col("before") + F.sum("size").over(run))
    # the one document across the border counts if it leaves less over than it would leave out
    takes = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + F.col("size")))
    edge = edge.withColumn("more", takes.cast("int")).drop("upto")
    out = plain.where("more IS NOT NULL").unionByName(edge).withColumn("copies", F.col("epochs") + F.col("more"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("source"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_source_mix(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
