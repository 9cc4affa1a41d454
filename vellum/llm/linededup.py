"""Operator 8: repeated runs of lines, found by winnowing. DataFrame functions only.

A run is a number of consecutive lines (blank ones between them aside); it repeats if the same lines stood before, in an
earlier document (in the order of id, then text hash) or earlier in its own, clear of it. Every later run of at least
min_words words is deleted, with all its lines, whether long or short; the first occurrence stays.

1. Each line with a word is hashed (96 bits, white space at its ends ignored). A window is the shortest run of lines with
   min_words words from a line on, forwards, or, for a line that is shorter alone, also backwards.
2. Winnowing: the least line hash of a window is its fingerprint. A repeated run of min_words words holds a whole window at
   each of its lines, so its fingerprints are the same wherever it stands: none can be missed.
3. Positions are joined by fingerprints: windows whose fingerprint stands at one position only are unique and go no further.
4. Matches are extended both ways: the lines that a window has before and after its fingerprint are compared by their
   hashes with those of *all* windows of the same fingerprint, by one row for each distinct window (its first position),
   not one for each pair; so a line that a third of all documents share costs no more, and a run is found whatever other
   places its single lines first stood at. Windows overlap, so longer matches grow window by window, forwards and backwards.
5. Windows that stood before are joined into runs, and the runs are deleted.

All steps are linear in the lines, in a text of any length: a window has at most min_words lines.

Cases: null text stays null, empty text empty; a document all of whose lines are later repeats stays, with an empty text;
blank lines go only inside a deleted run; repeated rows (same id and text) are one document: they get the same result;
null ids come first in order; an empty table gives an empty result; texts and lines of any length are whole; other columns
pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Scratch, numbered, table, word_count, written

MIN_WORDS = 10
SPACE = " \t\n\x0b\x0c\r"


def line_windows(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """id, th (text hash), a, b (first and last of its lines, among those with words), first, last (their line numbers), k1, k2 (hash of all lines), fp (least line hash) and at (its line) of each window."""
    line = lambda x: F.btrim(x, F.lit(SPACE))
    number = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(line(x)).alias("h1"), F.hash(line(x), F.length(line(x))).alias("h2"), word_count(x).alias("words"))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.filter(F.transform(F.split(text_col, "\n", -1), number), lambda x: x["words"] > 0).alias("lines"))
    grown = f"""(w, y) -> IF(w.words >= {min_words}, w, named_struct('words', w.words + y.words, 'lines', w.lines + 1, 'end', y.pos, 'k1', xxhash64(w.k1, y.h1), 'k2', hash(w.k2, y.h2),
        'fp', least(w.fp, y.h1), 'at', IF(y.h1 < w.fp OR w.lines = 0, w.lines, w.at)))"""
    none = lambda tag: f"named_struct('words', 0L, 'lines', 0, 'end', 0, 'k1', {tag}L, 'k2', {tag}, 'fp', {(1 << 63) - 1}L, 'at', 0)"
    # a line that is long enough is a window alone, whichever way one looks
    forwards = f"transform(lines, (x, i) -> aggregate(IF(x.words >= {min_words}, array(x), slice(lines, i + 1, {min_words})), {none(0)}, {grown}, w -> named_struct('words', w.words, 'a', i, 'b', i + w.lines - 1, 'first', x.pos, 'last', w.end, 'k1', w.k1, 'k2', w.k2, 'fp', w.fp, 'at', i + w.at)))"
    backwards = f"transform(lines, (x, i) -> IF(x.words >= {min_words}, NULL, aggregate(reverse(slice(lines, greatest(i + 2 - {min_words}, 1), least(i + 1, {min_words}))), {none(1)}, {grown}, w -> named_struct('words', w.words, 'a', i - w.lines + 1, 'b', i, 'first', w.end, 'last', x.pos, 'k1', w.k1, 'k2', w.k2, 'fp', w.fp, 'at', i - w.at))))"
    found = docs.select("id", "th", F.explode(F.expr(f"filter(concat({forwards}, {backwards}), w -> w.words >= {min_words})")).alias("w"))
    return found.select("id", "th", *[F.col(f"w.{c}").alias(c) for c in ("a", "b", "first", "last", "k1", "k2", "fp", "at")])


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, th and runs (array of struct<first, last> line numbers, both included, in order) of each document with later repeats."""
    with Scratch(df.sparkSession) as scratch:
        return _runs(scratch, scratch.written(line_windows(df, id_col, text_col, min_words), "line-windows"))


def _runs(scratch: Scratch, windows: DataFrame) -> DataFrame:
    # positions of a fingerprint, each as one number; written, as the tables below, so that each join's sides are dealt out
    # by the join alone and Spark can split the part of a common line
    spot = F.xxhash64("id", "th", "at")
    twice = windows.groupBy("fp").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one <> other").select("fp")
    twice = scratch.written(twice, "line-prints")
    met = scratch.written(windows.join(twice, "fp", "left_semi").drop("fp", "at"), "met-windows")
    before = met.groupBy("k1", "k2").agg(F.min(F.struct("id", "th", "a", "b")).alias("f"), F.count("*").alias("n")).where("n > 1")
    before = scratch.written(before.select("k1", "k2", F.col("f.id").alias("fid"), F.col("f.th").alias("fth"), F.col("f.b").alias("fb")), "first-windows")
    itself = F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")) & (F.col("a") <= F.col("fb"))
    later = scratch.written(met.join(before, ["k1", "k2"]).where(~itself).select("id", "th", "a", "b", "first", "last"), "later-windows")
    # windows that overlap or follow each other are one run; repeated rows have the same windows
    later = later.groupBy("id", "th", "a").agg(F.max("b").alias("b"), F.min("first").alias("first"), F.max("last").alias("last"))
    order = W.partitionBy("id", "th").orderBy("a")
    later = later.withColumn("fresh", (F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = later.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return written(runs, "line-runs")[0]


def without_runs(lines: str, runs: str) -> Column:
    """The text of the column `lines` without the lines of `runs`: what stands between them, piece by piece."""
    gaps = F.expr(f"zip_with(concat(array(0), transform({runs}, r -> r.last + 1)), concat(transform({runs}, r -> r.first), array(size({lines}))), (s, e) -> named_struct('s', s, 'e', e))")
    kept = F.filter(gaps, lambda g: g["e"] > g["s"])
    return F.array_join(F.transform(kept, lambda g: F.array_join(F.slice(lines, g["s"] + 1, g["e"] - g["s"]), "\n")), "\n")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, runs_col: str | None = None) -> DataFrame:
    """df with later repeated runs deleted from its texts; with runs_col also the deleted runs (null: none) under that name."""
    names = df.columns
    rows = numbered(df)
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    runs = repeated_runs(rows, key, text, min_words)
    out = rows.withColumn("th", F.xxhash64(text)).join(runs.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "runs"), F.col(key).eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    out = out.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split(text, "\n", -1)))
    cut = F.when(F.col("runs").isNull(), F.col(text)).otherwise(without_runs("lines", "runs"))
    return out.select(*[(cut if c == text else F.col(c)).alias(n) for c, n in zip(rows.columns, names)], *([F.col("runs").alias(runs_col)] if runs_col else []))


def op8_line_winnow(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"), "text")
    out = dedup_lines(docs, runs_col="removed_runs")
    removed = F.aggregate(F.coalesce("removed_runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    listed = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"], r["last"])), ",")
    return out.select("doc_id", "text", F.size(F.split("whole", "\n", -1)).alias("n_lines"), removed.alias("n_removed"), F.coalesce(listed, F.lit("")).alias("removed_runs"))


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """The query in DuckDB SQL: all windows by their whole text, without hashes and fingerprints. doc_id has to be unique and not null."""
    return f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
worded AS (SELECT *, row_number() OVER o AS n, sum(words) OVER o AS upto FROM (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, len(regexp_extract_all(line, '{WORD}')) AS words FROM l) WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, upto - words AS before FROM worded),
windows AS (
  SELECT doc_id, n AS a, max(n) OVER f AS b, pos AS first, max(pos) OVER f AS last, 'f' || string_agg(x, chr(10)) OVER f AS body, sum(words) OVER f AS total FROM w
    WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
  UNION ALL SELECT doc_id, a, b, first, last, body, total FROM (
    SELECT doc_id, words, min(n) OVER g AS a, n AS b, min(pos) OVER g AS first, pos AS last, 'b' || string_agg(x, chr(10)) OVER g AS body, sum(words) OVER g AS total FROM w
      WINDOW g AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)) WHERE words < {min_words}),
whole AS (SELECT * FROM windows WHERE total >= {min_words}),
firsts AS (SELECT body, min({{'d': doc_id, 'a': a, 'b': b}}) AS f FROM whole GROUP BY body HAVING count(*) > 1),
later AS (SELECT whole.* FROM whole JOIN firsts ON firsts.body = whole.body WHERE NOT (doc_id = f.d AND a <= f.b)),
m AS (SELECT doc_id, a, max(b) AS b, min(first) AS first, max(last) AS last FROM later GROUP BY doc_id, a),
o AS (SELECT *, CAST(a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 AS INTEGER) AS fresh FROM m),
runs AS (SELECT doc_id, run, min(first) AS first, max(last) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM o) GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(last - first + 1) AS n, string_agg(first || '-' || last, ',' ORDER BY first) AS said FROM runs GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l LEFT JOIN runs ON runs.doc_id = l.doc_id AND pos BETWEEN first AND last WHERE runs.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines, CAST(coalesce(gone.n, 0) AS INTEGER) AS n_removed, coalesce(said, '') AS removed_runs
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id"""
