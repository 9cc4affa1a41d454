"""A training corpus from `documents`: toxicity, line dedup, near-dedup, mixing to target weights, packing.

STAGES are functions of (spark, docs, sf_dir). Each result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; each works on all that its predecessor kept.

Cases, beyond those of the operators: extra columns of docs pass through all filtering stages whatever their names (the
operators work on numbered columns); of rows that differ in extra columns only always the same one stays; an empty table passes through all stages; a null text passes toxicity and line dedup as it is, counts as a text without words
in near-dedup (one of those stays), and takes no part in mixing, which returns documents that the mix takes at least once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import linededup, mixing, packing, simhash, toxicity
from vellum.llm.common import numbered, one_of_each, table, word_count, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 1 predicts as toxic go."""
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names, rows = docs.columns, numbered(docs)
    scored = toxicity.score(rows, models, f"c{names.index('doc_id')}", f"c{names.index('text')}", keep=tuple(rows.columns))
    return scored.where("predicted = 0").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts (operator 8); documents stay, n_chars follows."""
    out, names = numbered(linededup.dedup_lines(docs)), docs.columns
    kinds = dict(zip(names, docs.schema.fields))
    length = F.length(f"c{names.index('text')}")
    return out.select(*[(length.cast(kinds[n].dataType) if n == "n_chars" else F.col(c)).alias(n) for c, n in zip(out.columns, names)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays (operator 7 on five-word shingles, similarity 0.8)."""
    return simhash.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 10)."""
    spot = lambda i, own, of: F.struct(i.alias("id"), own.alias("hash"), of.cast("string").alias("of")).alias("spot")
    mixed = mixing.mix(docs).groupBy(spot(F.col("doc_id"), F.col("text_hash"), F.col("source"))).agg(F.sum("copies").alias("copies")).where("copies > 0")
    names, rows = docs.columns, numbered(docs)
    i, text, source = (f"c{names.index(n)}" for n in ("doc_id", "text", "source"))
    # rows that agree in id, text and source are one document here; the mix has added up their copies. The three are one value,
    # nulls included, so that texts are shuffled once, for the choice among equal rows and for the join
    once = one_of_each(rows.withColumn("spot", spot(F.col(i), F.xxhash64(text), F.col(source)).cast(mixed.schema["spot"].dataType)), ["spot"], [c for c in rows.columns if c not in (i, text, source)])
    found = once.join(mixed, "spot")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names)])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each run of words of each document lies in the training sequences (operator 5)."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("salt"))
    return packing.pack_documents(sized, salt=F.col("salt"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier's score, XXH64 and best-fit have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs, f"stage-{name}")
    return docs
