"""Operator 1: toxicity by non-negative positive-unlabelled learning.

Numpy classifiers learn from confirmed toxic texts (positives) and unlabelled texts. With the class prior p the risk is
  p * E_pos[loss(f, 1)] + max(0, E_unl[loss(f, 0)] - p * E_pos[loss(f, 0)]),
the logistic loss, whose correction stays non-negative: when the bracket falls below zero its gradient is turned round.

Features are the distinct words of the whole text (letters and digits, A-Z lowered) and their beginnings, hashed; the
fit keeps those that tell positives from unlabelled texts. Only these reach a score:
never label, lang, source or id. The classifiers are fitted on samples bounded by MAX_POSITIVE and MAX_UNLABELLED (the
documents with the smallest hashes of their ids, which the driver gets as hashed features, not texts); every document is
scored. Documents whose crc32(id) modulo FOLDS is HELD_OUT lend neither label nor text to the fit.

Cases: null and empty texts get the score of no words; without confirmed toxic texts every score is the least prior;
labels of unknown documents, null labels and null ids are ignored; a document with several labels is toxic if any says
so; repeated rows are scored alike (and count once in the fit); texts of any length are whole; other input columns may have any name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table, utf8_values, worker_cache, written

FOLDS, HELD_OUT = 5, 0
#: Bounds of the fitting samples.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
BUCKETS = 1 << 20
#: A feature must occur in so many texts of the samples, and tell positives from unlabelled texts by so many standard errors.
MIN_TEXTS, MIN_Z = 4, 4.0
MODELS, STEPS, RATE, DECAY = 3, 200, 0.1, 1e-4
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.5
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of a word's beginnings that are features as well.
STEMS = (4, 5, 6, 7)
KEPT_WORDS = 300_000


def features_of(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings, which stand for a stem with many endings."""
    return [zlib.crc32(x) % BUCKETS for x in (word, *(word[:k] + b"-" for k in STEMS if len(word) > k))]


def features(text: bytes) -> np.ndarray:
    """Hashed distinct words and stems."""
    return np.array(sorted({h for w in set(TOKEN.findall(text.lower())) for h in features_of(w)}), np.int64)


def standard_errors(seen, n, seen_other, m):
    """How many standard errors a feature's share of n texts lies from its share of m others; for numbers and Columns."""
    common = (seen + seen_other + 1) / (n + m + 2)
    return (seen / n - seen_other / m) / (common * (1 - common) * (1 / n + 1 / m)) ** 0.5


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose share among positives differs from that among unlabelled texts by MIN_Z standard errors."""
    seen = [np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]), minlength=BUCKETS) for x in (positive, unlabelled)]
    z = standard_errors(seen[0], max(1, len(positive)), seen[1], max(1, len(unlabelled)))
    return np.flatnonzero((np.abs(z) >= MIN_Z) & (seen[0] + seen[1] >= MIN_TEXTS))


def nn_risk(f: np.ndarray, of_pos: np.ndarray, of_unl: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk, bracket, gradient by f) of scores f, first of the positives, then of the unlabelled texts, with row weights that sum to 1 in each.

    The risk takes the bracket as 0 where it is negative; there the gradient is that of minus the bracket, which leads back.
    """
    n_pos = len(of_pos)
    q = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    against, towards = np.logaddexp(0, f), np.logaddexp(0, -f)  # the loss of 0 and of 1
    bracket = (of_unl * against[n_pos:]).sum() - prior * (of_pos * against[:n_pos]).sum()
    risk = prior * (of_pos * towards[:n_pos]).sum() + max(0.0, bracket)
    if bracket >= 0:
        g = np.concatenate([prior * of_pos * (q[:n_pos] - 1) - prior * of_pos * q[:n_pos], of_unl * q[n_pos:]])
    else:
        g = np.concatenate([prior * of_pos * q[:n_pos], -of_unl * q[n_pos:]])
    return risk, bracket, g


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 0, steps: int = STEPS, kept: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights over BUCKETS, bias) of one classifier over the features in kept. The samples are lists of feature arrays."""
    rows = [*positive, *unlabelled]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    kept = telling(positive, unlabelled) if kept is None else kept
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(kept.size)
    row_of, column = np.repeat(np.arange(len(rows)), sizes), place[flat]
    row_of, column = row_of[column >= 0], column[column >= 0]
    n_pos, n = len(positive), len(rows)
    w, b = np.zeros(kept.size), float(np.log(prior / (1 - prior)))
    # each classifier sees its own draw of row weights (a Bayesian bootstrap)
    draw = np.random.default_rng(seed).exponential(size=n)
    of_pos, of_unl = draw[:n_pos] / draw[:n_pos].sum(), draw[n_pos:] / draw[n_pos:].sum()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        f = b + np.bincount(row_of, weights=w[column], minlength=n)
        g = nn_risk(f, of_pos, of_unl, prior)[2]
        gw = np.bincount(column, weights=g[row_of], minlength=kept.size) + DECAY * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    full = np.zeros(BUCKETS)
    full[kept] = w
    return full, b


def fold(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` ids, those with the least hashes; each task keeps its first."""
    return ids.select("id").distinct().orderBy(F.xxhash64(F.lit(7), F.col("id").cast("string")), "id").limit(most)


def _hashed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, pos, f): hashed features of the sampled texts, one row an id. ids(id, pos) has at most the bounds' rows."""
    found = docs.join(F.broadcast(ids), "id")
    kind = docs.schema["id"].dataType.simpleString()
    rows = map_rows(found.select("id", "pos", "text"), lambda b: {"id": b.column(0), "pos": b.column(1), "f": pa.array([features(t) for t in utf8_values(b.column(2))], pa.list_(pa.int64()))}, f"id {kind}, pos int, f array<long>")
    return written(rows.groupBy("id", "pos").agg(F.min("f").alias("f")), "toxic-sample")[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> list[tuple[np.ndarray, float]]:
    """The classifiers, fitted on bounded samples of the folds that are not held out."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic")).where(fold(F.col("id")) != HELD_OUT)
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, toxic / n if n else 0))
    if not toxic:
        return []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    here = texts.select("id").where(F.col("id").isNotNull() & (fold(F.col("id")) != HELD_OUT))
    positive = _sample(marks.where("toxic = 1").join(here, "id", "left_semi"), max_positive).withColumn("pos", F.lit(1))
    sample = _hashed(texts, positive.unionByName(_sample(here, max_unlabelled).withColumn("pos", F.lit(0))))
    n_pos, n_unl = sample.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum(1 - F.col("pos")), F.lit(0))).first()
    if not n_pos or not n_unl:
        return []
    # features are counted and chosen before any of them comes to the driver
    counts = sample.select("pos", F.explode("f").alias("h")).groupBy("h").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("u")).where(F.col("p") + F.col("u") >= MIN_TEXTS)
    counts = counts.where(F.abs(standard_errors(F.col("p"), n_pos, F.col("u"), n_unl)) >= MIN_Z)
    kept = np.array(sorted(r.h for r in counts.select("h").collect()), np.int64)  # at most BUCKETS numbers, a few thousand in practice
    slim = map_rows(sample.select("id", "pos", "f"), lambda b: {"id": b.column(0), "pos": b.column(1), "f": pa.array([np.intersect1d(np.asarray(x, np.int64), kept, True) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))}, f"id {sample.schema['id'].dataType.simpleString()}, pos int, f array<long>")
    rows = slim.orderBy("pos", "id").toPandas()  # at most max_positive + max_unlabelled rows
    split = lambda pos: [np.asarray(x, np.int64) for x in rows["f"][rows["pos"] == pos]]
    return [fit_nnpu(split(1), split(0), prior, seed, kept=kept) for seed in range(MODELS)]


def score(docs: DataFrame, models: list[tuple[np.ndarray, float]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score, predicted (and the columns in keep) for every row: the mean of the classifiers' probabilities."""
    words = np.flatnonzero(sum((np.abs(w) for w, _ in models), np.zeros(BUCKETS)))
    weight = np.stack([w[words] for w, _ in models]).astype(np.float64) if models else np.zeros((0, 0))
    bias = np.array([b for _, b in models])
    shipped = docs.sparkSession.sparkContext.broadcast((words, weight, bias))  # at most BUCKETS weights
    stamp = zlib.crc32(weight.tobytes() + bias.tobytes())
    names = [f"k{i}" for i in range(len(keep))]

    def run(batch: pa.RecordBatch) -> dict:
        words, weight, bias = shipped.value
        cache = worker_cache()
        if cache.get("toxic_stamp") != stamp:
            cache["toxic_place"], cache["toxic_words"], cache["toxic_stamp"] = dict(zip(words.tolist(), range(len(words)))), {}, stamp
        place, known = cache["toxic_place"], cache["toxic_words"]
        out = []
        for text in utf8_values(batch.column(1)):
            if not len(bias):
                out.append(LEAST_PRIOR)
                continue
            used = set()
            for w in set(TOKEN.findall(text.lower())):
                at = known.get(w)
                if at is None:
                    at = tuple(place[h] for h in features_of(w) if h in place)
                    if len(w) <= 64 and len(known) < KEPT_WORDS:
                        known[w] = at
                if at:
                    used.update(at)
            f = bias + (weight[:, sorted(used)].sum(axis=1) if used else 0)
            out.append(float((1 / (1 + np.exp(-np.clip(f, -30, 30)))).mean()))
        return {"id": batch.column(0), "score": out, "predicted": pa.array([int(x >= 0.5) for x in out], pa.int32())} | {n: batch.column(i + 2) for i, n in enumerate(names)}

    kinds = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))])
    out = map_rows(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(n) for n, c in zip(names, keep))), run, kinds)
    return out.withColumnRenamed("id", id_col)


def op1_toxicity_pu(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
