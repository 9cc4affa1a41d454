"""Operator 6: licence scans. DataFrame functions only.

Statements are compared with the sentences of licence templates by the cosine of TF-IDF vectors, kept sparse as (statement,
term, weight) rows; a term's document frequency is counted over all documents. A statement is a piece of a text (a line, cut at
sentence ends), or two or three pieces that follow each other over line ends, as in a wrapped header. Nothing is left out by a
word list: a piece is dropped only where the terms that templates know weigh too little in it for any cosine to reach
MIN_COSINE, which is exact, as a cosine is at most the share of the vector's length that lies in those terms; the pieces
that are left are the ones that may be joined.

A file's licence is that of its best statement with a cosine of at least MIN_COSINE. A licence file (by its name, or when pieces
within such statements make up at least LICENSE_SHARE of its words) also licenses its directory, and a file without a licence
of its own inherits that of the nearest ancestor directory that has one: directories are joined with their ancestors'
paths, then files with their directory.

Only template terms and their frequencies are broadcast or collected: their number is that of the templates' words.

Cases: null and empty texts have no licence of their own and may inherit; a null path lies in no directory; ties go to the higher
cosine, then the licence's name; a directory with several licence files takes the one with the largest share, then the first
path; repeated rows (same path and text) are one file and get the same result each; an empty table gives an empty result;
whole texts are scanned; other input columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, table, word_count, written

#: Licence: sentences of its usual headers and files.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0",),
    "Proprietary": ("All rights reserved",),
}
MIN_COSINE, LICENSE_SHARE = 0.6, 0.15
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
TOKEN = "[^a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), TOKEN), "")


def tokens_of(text: str) -> list[str]:
    import re

    return [t for t in re.split(TOKEN, text.translate({c: c + 32 for c in range(65, 91)})) if t]


def idf(df_count: float, n: float) -> float:
    return math.log((n + 1) / (df_count + 1)) + 1


def least_ratio(min_cosine: float) -> float:
    """For a cosine of min_cosine, the squared weight of known terms must be at least this many times that of all others."""
    return min_cosine**2 / (1 - min_cosine**2)


def pieces(text: Column, vocabulary: list[str]) -> Column:
    """Array of struct<i, s, n, h>: number, lower-case text, number of tokens and known tokens of each piece of a text."""
    cut = F.split(lower_ascii(text), r"\n|(?<=[.;!?])[ \t]+", -1)
    terms = F.transform(cut, lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.array_remove(F.split(s, TOKEN), "").alias("t")))
    return F.transform(terms, lambda p: F.struct(p["i"].alias("i"), p["s"].alias("s"), F.size(p["t"]).alias("n"), F.filter(p["t"], lambda x: x.isin(*vocabulary)).alias("h")))


def bounded(column: str, ratio: float, weight: str, unknown: float) -> Column:
    """The pieces of the column in which the known terms weigh enough. weight: SQL for the squared weight of the term x; unknown: the squared weight of any other."""
    squares = f"aggregate(array_sort(p.h), named_struct('t', '', 'r', 0, 'w', 0D), (a, x) -> IF(x = a.t, named_struct('t', x, 'r', a.r + 1, 'w', a.w + {weight} * (2 * a.r + 1)), named_struct('t', x, 'r', 1, 'w', a.w + {weight})), a -> a.w)"
    most = f"CAST(size(p.h) AS DOUBLE) * size(p.h) * {unknown!r}D >= {ratio * unknown!r}D * (p.n - size(p.h))"
    return F.expr(f"filter({column}, p -> size(p.h) > 0 AND {most} AND {squares} >= {ratio * unknown!r}D * (p.n - size(p.h)))")


def statements(column: str) -> Column:
    """Array of struct<s, parts> (parts: numbers and words of its pieces) of the pieces alone and joined over line ends."""
    part = lambda p: f"named_struct('i', {p}.i, 'n', {word_count_sql(f'{p}.s')})"
    at = lambda k: f"{column}[j + {k}]"
    follows = lambda k: f"{at(k)}.i = {at(k - 1)}.i + 1 AND NOT {at(k - 1)}.s RLIKE '[.;!?]$'"
    made = [f"transform({column}, p -> named_struct('s', p.s, 'parts', array({part('p')})))"]
    for n in (2, 3):
        several = " AND ".join(follows(k) for k in range(1, n))
        joined = f"named_struct('s', concat_ws(' ', {', '.join(f'{at(k)}.s' for k in range(n))}), 'parts', array({', '.join(part(at(k)) for k in range(n))}))"
        made.append(f"IF(size({column}) < {n}, array(), transform(filter(sequence(0, greatest(0, size({column}) - {n})), j -> {several}), j -> {joined}))")
    return F.expr(f"concat({', '.join(made)})")


def word_count_sql(text: str) -> str:
    return f"CAST(regexp_count({text}, '{WORD}') AS BIGINT)"


def rows_of(spark, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small table of constants."""
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r)]) for r in rows])))


def ancestors(path: Column) -> Column:
    """The directories that hold a path, the nearest first; the last is the root, ''."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_cosine: float = MIN_COSINE, license_share: float = LICENSE_SHARE) -> DataFrame:
    """id, path, license, score, origin (own, inherited, none) and license_path for each row of df."""
    spark, text = df.sparkSession, F.col(text_col)
    sentences = [(name, tokens_of(s)) for name, many in templates.items() for s in many]
    vocabulary = sorted({t for _, s in sentences for t in s})
    ratio = least_ratio(min_cosine)
    files = df.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("text")).select("id", "path", F.xxhash64("path", "text").alias("k"), pieces(F.col("text"), vocabulary).alias("p"), word_count(F.col("text")).alias("words"))
    none = F.array().cast("array<string>")
    known = F.coalesce(F.array_distinct(F.flatten(F.transform("p", lambda p: p["h"]))), none)
    # the bound at weights that no term exceeds, as they are not known yet
    files, _ = written(files.select("id", "path", "k", known.alias("known"), F.when(known != none, bounded("p", ratio, "1D", 1.0)).alias("p"), "words"), "license-files")
    # how many documents hold each template term; one row a term
    counts = dict(files.select(F.explode("known").alias("t")).groupBy("t").count().collect())
    n = files.count()
    weight = {t: idf(counts.get(t, 0), n) for t in vocabulary}
    rows = []
    for number, (name, sentence) in enumerate(sentences):
        v = {t: sentence.count(t) * weight[t] for t in set(sentence)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(t, number, name, x / norm) for t, x in v.items()]
    of_template = F.broadcast(rows_of(spark, ("t", "number", "license", "x"), rows))
    of_term = F.broadcast(rows_of(spark, ("t", "idf"), list(weight.items())))
    squared = "element_at(map(" + ", ".join(f"'{t}', {w * w!r}D" for t, w in weight.items()) + "), x)"
    likely = files.where("size(p) > 0").select("k", "words", bounded("p", ratio, squared, idf(0, n) ** 2).alias("p")).where("size(p) > 0")
    # one row for each distinct statement, whatever the number of files that make it
    made, _ = written(likely.select("k", "words", F.explode(statements("p")).alias("x")).select("k", "words", "x.s", "x.parts").distinct(), "license-statements")
    said = made.select("s").distinct().select("s", F.xxhash64("s").alias("sk"), tokens(F.col("s")).alias("ts"))
    terms = said.select("sk", "s", F.explode("ts").alias("t")).groupBy("sk", "s", "t").agg(F.count("*").alias("tf"))
    weighed = terms.join(of_term, "t", "left").withColumn("x1", F.col("tf") * F.coalesce("idf", F.lit(idf(0, n))))
    norms = weighed.groupBy("sk", "s").agg(F.sqrt(F.sum(F.col("x1") * F.col("x1"))).alias("norm"))
    dots = weighed.join(of_template, "t").groupBy("sk", "s", "number", "license").agg(F.sum(F.col("x1") * F.col("x")).alias("dot"))
    cosines = dots.join(norms, ["sk", "s"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= min_cosine)
    best = cosines.groupBy("s").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("s", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))
    hits = made.join(best, "s")
    inside = hits.select("k", "words", F.explode("parts").alias("part")).distinct().groupBy("k").agg((F.sum("part.n") / F.max("words")).alias("share"))
    own = hits.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).join(inside, "k")
    own, _ = written(own.select("k", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), "share"), "license-own")
    found = files.select("id", "path", "k").join(own, "k", "left")
    found, _ = written(found.withColumn("dir", F.when(F.col("path").isNotNull(), F.element_at(ancestors(F.col("path")), 1))), "license-found")
    # licences of directories, then of each distinct directory from its nearest licensed ancestor
    named = found.where(F.col("license").isNotNull() & F.col("dir").isNotNull() & (F.col("path").rlike(LICENSE_NAME) | (F.col("share") >= license_share)))
    licensed = named.groupBy("dir").agg(F.min(F.struct((-F.col("share")).alias("minus"), "path", "license", "score")).alias("b")).select(F.col("dir").alias("up"), F.col("b.path").alias("from"), F.col("b.license").alias("dir_license"), F.col("b.score").alias("dir_score"))
    dirs = found.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(F.concat(F.array("dir"), F.when(F.col("dir") != "", ancestors(F.col("dir"))).otherwise(F.array().cast("array<string>")))).alias("steps", "up"))
    inherited = above.join(licensed, "up").groupBy("dir").agg(F.min_by(F.struct("from", "dir_license", "dir_score"), "steps").alias("x"))
    bare = found.where("license IS NULL").join(inherited, "dir", "left")
    origin = F.when(F.col("x").isNotNull(), "inherited").otherwise("none")
    bare = bare.select("id", "path", F.col("x.dir_license").alias("license"), F.col("x.dir_score").alias("score"), origin.alias("origin"), F.col("x.from").alias("license_path"))
    mine = found.where("license IS NOT NULL").select("id", "path", "license", "score", F.lit("own").alias("origin"), F.col("path").alias("license_path"))
    return mine.unionByName(bare).withColumnRenamed("id", id_col)


def corpus_path() -> Column:
    """Files of the corpus by source, language and shelf of a hundred documents."""
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-")), F.concat(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".txt")))


def op6_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), corpus_path())


def oracle_sql(templates=TEMPLATES) -> str:
    """The corpus query in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(name)}, {quote(s)})" for k, (name, s) in enumerate((n, s) for n, many in templates.items() for s in many))
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    toks = lambda c: f"list_filter(regexp_split_to_array({low(c)}, '[^a-z0-9]+'), lambda w: w <> '')"
    n_words = lambda c: f"len(regexp_extract_all({c}, '[^\\x20\\x09-\\x0D]+'))"
    return f"""
WITH RECURSIVE t(number, license, sentence) AS (VALUES {rows}),
tt AS (SELECT number, license, term, count(*) AS tf FROM (SELECT number, license, unnest({toks('sentence')}) AS term FROM t) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM tt),
f AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 100) || '/doc' || doc_id || '.txt' AS path, text, {n_words('text')} AS words FROM documents),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS c FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM f)) JOIN vocabulary USING (term) GROUP BY term),
idf AS (SELECT term, ln((n.n + 1) / (coalesce(c, 0) + 1)::DOUBLE) + 1 AS w FROM vocabulary LEFT JOIN df USING (term), n),
tw AS (SELECT number, license, term, tf * w AS x FROM tt JOIN idf USING (term)),
tn AS (SELECT number, sqrt(sum(x * x)) AS norm FROM tw GROUP BY number),
cut AS (SELECT doc_id, words, regexp_split_to_array(regexp_replace({low('text')}, '([.;!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\n') AS l FROM f),
pt AS (SELECT doc_id, words, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM cut),
pw AS (SELECT s, t.term, tf, w FROM (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest({toks('s')}) AS term FROM (SELECT DISTINCT s FROM pt)) GROUP BY ALL) t LEFT JOIN idf ON idf.term = t.term),
likely AS (SELECT s FROM pw, n GROUP BY s, n.n HAVING count(w) > 0 AND coalesce(sum(CASE WHEN w IS NOT NULL THEN tf * w * tf * w END), 0) >= {least_ratio(MIN_COSINE)!r} * power(ln(n.n + 1) + 1, 2) * coalesce(sum(CASE WHEN w IS NULL THEN tf END), 0)),
pp AS (SELECT pt.*, {n_words('pt.s')} AS n FROM pt JOIN likely ON likely.s = pt.s),
two AS (SELECT a.doc_id, a.words, a.i, b.i AS j, a.s || ' ' || b.s AS s FROM pp a JOIN pp b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE NOT regexp_matches(a.s, '[.;!?]$')),
three AS (SELECT a.doc_id, a.words, a.i, b.i AS j, a.s || ' ' || b.s AS s FROM two a JOIN pp b ON a.doc_id = b.doc_id AND b.i = a.j + 1 WHERE NOT regexp_matches(a.s, '[.;!?]$')),
made AS (SELECT doc_id, words, i, i AS j, s FROM pp UNION ALL SELECT doc_id, words, i, j, s FROM two UNION ALL SELECT doc_id, words, i, j, s FROM three),
st AS (SELECT s, term, count(*) AS tf FROM (SELECT s, unnest({toks('s')}) AS term FROM (SELECT DISTINCT s FROM made)) GROUP BY ALL),
sw AS (SELECT s, st.term, tf * coalesce(w, ln(n.n + 1) + 1) AS x FROM st LEFT JOIN idf ON idf.term = st.term, n),
sn AS (SELECT s, sqrt(sum(x * x)) AS norm FROM sw GROUP BY s),
cosine AS (SELECT sw.s, tw.license, round(sum(sw.x * tw.x) / any_value(tn.norm) / any_value(sn.norm), 6) AS score
           FROM sw JOIN tw ON tw.term = sw.term JOIN tn ON tn.number = tw.number JOIN sn ON sn.s = sw.s GROUP BY sw.s, tw.number, tw.license),
best AS (SELECT s, license, score FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, license) AS r FROM cosine WHERE score >= {MIN_COSINE}) WHERE r = 1),
hits AS (SELECT doc_id, words, i, j, license, score FROM made JOIN best ON best.s = made.s),
inside AS (SELECT doc_id, sum(n) / max(words) AS share FROM (SELECT DISTINCT pp.doc_id, pp.words, pp.i, pp.n FROM pp JOIN hits ON hits.doc_id = pp.doc_id AND pp.i BETWEEN hits.i AND hits.j) GROUP BY doc_id),
own AS (SELECT hits.doc_id, min({{'minus': -score, 'license': license}}) AS b, any_value(share) AS share FROM hits JOIN inside ON inside.doc_id = hits.doc_id GROUP BY hits.doc_id),
found AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own.b.license AS license, -own.b.minus AS score, share FROM f LEFT JOIN own ON own.doc_id = f.doc_id),
licensed AS (SELECT dir, min({{'minus': -share, 'path': path, 'license': license, 'score': score}}) AS b FROM found WHERE license IS NOT NULL AND share >= {LICENSE_SHARE} GROUP BY dir),
up(dir, above, steps) AS (SELECT DISTINCT dir, dir, 0 FROM found WHERE license IS NULL
  UNION ALL SELECT dir, CASE WHEN above LIKE '%/%' THEN regexp_replace(above, '/[^/]*$', '') ELSE '' END, steps + 1 FROM up WHERE above <> ''),
near AS (SELECT dir, b FROM (SELECT up.dir, licensed.b, row_number() OVER (PARTITION BY up.dir ORDER BY steps) AS r FROM up JOIN licensed ON licensed.dir = up.above) WHERE r = 1)
SELECT doc_id, path, license, score, 'own' AS origin, path AS license_path FROM found WHERE license IS NOT NULL
UNION ALL
SELECT doc_id, path, near.b.license, near.b.score, CASE WHEN near.b IS NULL THEN 'none' ELSE 'inherited' END, near.b.path FROM found LEFT JOIN near ON near.dir = found.dir WHERE license IS NULL"""
