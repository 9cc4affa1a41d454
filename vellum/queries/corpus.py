"""Queries over texts: dictionaries, n-grams, languages, noise, entities, structure, correction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import trim
from ..operators import correct, text, train

Q, SQL = {}, {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: DuckDB: what trimming takes off a line, and the words of a text.
TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 2)"
NGRAM_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}'']+'), lambda w: length(w) >= 2)"
SCORES = ", ".join(f"len(regexp_extract_all(text, '{p}'))" for _, p in text.LANGUAGE_SIGNS)
NAMES = ", ".join(f"'{n}'" for n, _ in text.LANGUAGE_SIGNS)
LANGUAGE = f"CASE WHEN length(text) < 10 OR list_max([{SCORES}]) = 0 THEN 'eng' ELSE [{NAMES}][list_position([{SCORES}], list_max([{SCORES}]))] END"


@query(f"""
WITH d AS (SELECT {LANGUAGE} AS language, {WORDS} AS ws FROM documents),
c AS (SELECT language, word, count(*) AS freq FROM (SELECT language, unnest(ws) AS word FROM d) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY freq DESC, word) AS rank FROM c)
SELECT language, word, CAST(freq AS BIGINT) AS freq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def top_words_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # the language in a projection below the explosion, else it is found again for every word
    words = docs.select(text.detect_language(F.col("text")).alias("language"), train.dictionary_words(F.col("text")).alias("ws")).select("language", F.explode("ws").alias("word"))
    counts = words.groupBy("language", "word").agg(F.count("*").alias("freq"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("language").orderBy(F.desc("freq"), "word"))).where("rank <= 20")


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word")
def dictionary_build(spark, sf_dir):
    return train.dictionary(table(spark, sf_dir, "documents"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5 AND length(word) >= 4")
def dictionary_filter(spark, sf_dir):
    return train.filter_by_frequency(train.dictionary(table(spark, sf_dir, "documents")), 5, 4)


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY word")
def dictionary_append(spark, sf_dir):
    return train.merge_counts(train.dictionary(table(spark, sf_dir, "documents")), train.dictionary(table(spark, sf_dir, "conversations")))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({NGRAM_WORDS}) AS word FROM documents) GROUP BY word")
def ngram_unigrams(spark, sf_dir):
    return train.unigrams(table(spark, sf_dir, "documents"))


PAIRS = f"SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {NGRAM_WORDS} AS w FROM documents) WHERE len(w) > 1)"


@query(f"SELECT w1, w2, count(*) AS freq FROM ({PAIRS}) GROUP BY w1, w2")
def ngram_bigrams(spark, sf_dir):
    return train.bigrams(table(spark, sf_dir, "documents"))


@query(f"""
WITH u AS (SELECT word, count(*) AS n FROM (SELECT unnest({NGRAM_WORDS}) AS word FROM documents) GROUP BY word),
b AS (SELECT w1, w2, count(*) AS n FROM ({PAIRS}) GROUP BY w1, w2)
SELECT (SELECT count(*) FROM u) AS unique_unigrams, (SELECT count(*) FROM b) AS unique_bigrams,
       (SELECT CAST(sum(n) AS BIGINT) FROM u) AS total_unigrams, (SELECT CAST(sum(n) AS BIGINT) FROM b) AS total_bigrams""")
def ngram_stats(spark, sf_dir):
    return train.NgramModel.train(table(spark, sf_dir, "documents")).stats()


@query(f"""
WITH u AS (SELECT word, count(*) AS n FROM (SELECT unnest({NGRAM_WORDS}) AS word FROM documents) GROUP BY word),
asked AS (SELECT DISTINCT unnest({NGRAM_WORDS}) AS word FROM conversations)
SELECT asked.word, round(coalesce(u.n, 0) / (SELECT sum(n) FROM u)::DOUBLE, 10) AS score FROM asked LEFT JOIN u ON u.word = asked.word""")
def word_score(spark, sf_dir):
    model = train.NgramModel.train(table(spark, sf_dir, "documents"))
    asked = train.unigrams(table(spark, sf_dir, "conversations")).select("word")
    return model.score_words(asked).withColumn("score", F.round("score", 10))


@query(f"""
WITH u AS (SELECT word, count(*) AS n FROM (SELECT unnest({NGRAM_WORDS}) AS word FROM documents) GROUP BY word),
b AS (SELECT w1, w2, count(*) AS n FROM ({PAIRS}) GROUP BY w1, w2),
asked AS (SELECT DISTINCT w1, w2 FROM ({PAIRS.replace('FROM documents', 'FROM conversations')}))
SELECT asked.w1, asked.w2, round(CASE WHEN u.n IS NULL THEN 0.0 ELSE coalesce(b.n, 0) / u.n::DOUBLE END, 10) AS score
FROM asked LEFT JOIN u ON u.word = asked.w1 LEFT JOIN b ON b.w1 = asked.w1 AND b.w2 = asked.w2""")
def bigram_score(spark, sf_dir):
    model = train.NgramModel.train(table(spark, sf_dir, "documents"))
    asked = train.bigrams(table(spark, sf_dir, "conversations")).select("w1", "w2")
    return model.score_bigrams(asked).withColumn("score", F.round("score", 10))


@query(f"SELECT doc_id, {LANGUAGE} AS language FROM documents")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(f"SELECT lang, {LANGUAGE} AS language, count(*) AS n FROM documents GROUP BY ALL")
def language_confusion_matrix(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", text.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, length(text) >= 5 AND (length(array_to_string(regexp_extract_all(text, '[a-zA-Z]{2,}'), ''))
  + length(array_to_string(regexp_extract_all(text, '[0-9]{2,}'), ''))) / length(text)::DOUBLE < 0.15 AS garbage FROM documents""")
def garbage_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_garbage_text(F.col("text")).alias("garbage"))


V, K = text.VOWELS, text.CONSONANTS


@query(f"""
WITH w AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents),
m AS (SELECT word, length(word) AS n, len(regexp_extract_all(word, '{V}')) AS v, len(regexp_extract_all(word, '{K}')) AS k,
  len(list_distinct(string_split(word, ''))) AS d,
  len(list_filter(range(1, length(word) - 1), lambda i: word[i] = word[i + 1] AND word[i] = word[i + 2])) > 0 AS thrice FROM w)
SELECT word, CASE WHEN n < 3 THEN true WHEN v + k = 0 THEN false WHEN v = 0 OR k = 0 THEN n <= 3
  ELSE v / (v + k)::DOUBLE BETWEEN 0.10 AND 0.90 AND (n < 4 OR d / n::DOUBLE >= 0.40) AND NOT thrice END AS "natural" FROM m""")
def natural_word_stats(spark, sf_dir):
    words = train.dictionary(table(spark, sf_dir, "documents")).select("word")
    return words.select("word", text.natural_word(F.col("word")).alias("natural"))


#: DuckDB: whether a word looks natural, from its lower-case form.
NATURAL = f"""(CASE WHEN length(w) < 3 THEN true
  WHEN len(regexp_extract_all(w, '{V}')) + len(regexp_extract_all(w, '{K}')) = 0 THEN false
  WHEN len(regexp_extract_all(w, '{V}')) = 0 OR len(regexp_extract_all(w, '{K}')) = 0 THEN length(w) <= 3
  ELSE len(regexp_extract_all(w, '{V}')) / (len(regexp_extract_all(w, '{V}')) + len(regexp_extract_all(w, '{K}')))::DOUBLE BETWEEN 0.10 AND 0.90
    AND (length(w) < 4 OR len(list_distinct(string_split(w, ''))) / length(w)::DOUBLE >= 0.40)
    AND len(list_filter(range(1, length(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) = 0 END)"""
THRICE = "len(list_filter(range(1, length({0}) - 1), lambda i: ({0})[i] = ({0})[i + 1] AND ({0})[i] = ({0})[i + 2])) > 0"


#: DuckDB: lines that are not blank, with `noise`.
JUDGED = f"""
l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_ix, trim(ls[i], ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS line
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT *, regexp_replace(line, '[^\\p{{L}}]', '', 'g') AS ls, regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+') AS ws FROM l WHERE line <> ''),
n AS (SELECT *, lower(ls) AS low, length(ls) AS k, length(line) AS len, len(ws) AS nw, len(regexp_extract_all(line, '[|()\\[\\]<>{{}}+=&#@*^~\\\\]')) AS symbols,
        list_filter(list_transform(ws, lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), lambda x: length(x) >= 3) AS checked FROM m),
g AS (SELECT doc_id, line_ix, count(*) FILTER (good) AS good, count(*) AS c FROM (SELECT doc_id, line_ix, {NATURAL} AS good FROM (SELECT doc_id, line_ix, lower(unnest(checked)) AS w FROM n)) GROUP BY ALL),
judged AS (SELECT n.doc_id, n.line_ix, n.line, CASE
  WHEN k <= 2 OR len < 8 OR k / greatest(1, length(regexp_replace(line, '\\s', '', 'g')))::DOUBLE < 0.4 THEN true
  WHEN k BETWEEN 5 AND 30 AND (len(list_distinct(string_split(low, ''))) / length(low)::DOUBLE < 0.40
       OR (len(list_distinct(string_split(low, ''))) / length(low)::DOUBLE < 0.50 AND {THRICE.format('low')})) THEN true
  WHEN NOT regexp_matches(line, '\\p{{L}}{{3,}}') THEN true
  WHEN (symbols >= 2 AND len < 40) OR symbols >= 3 THEN true
  WHEN len < 30 AND nw <= 5 AND regexp_matches(line, '\\p{{L}}[)\\]]') THEN true
  WHEN nw >= 4 AND len(list_filter(ws, lambda x: length(x) = 1)) / nw::DOUBLE > 0.4 THEN true
  WHEN len < 25 AND (coalesce(c, 0) = 0 OR (len < 15 AND good < c) OR (len >= 15 AND good = 0)) THEN true
  WHEN nw >= 4 AND len < 50 THEN coalesce(c, 0) >= 3 AND (c - good) / c::DOUBLE > 0.5
  ELSE false END AS noise
FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.line_ix = n.line_ix)"""


@query(f"WITH {JUDGED} SELECT doc_id, line_ix, line, noise FROM judged")
def noise_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_ix", "line")).withColumn("line", trim("line")).where("line <> ''")
    return lines.withColumn("noise", text.is_noise_line(F.col("line")))


def _edges(line: str) -> str:
    """DuckDB: the edges of a line cleaned; what Java looks ahead to is put back."""
    for a, b in ((r"^[0-9]\s+(\p{L})", r"\1"), (r"^\(\p{Lu}{1,2}\s+", ""), (r'^["«»]\p{L}{1,2}\s+', ""), (r"^[^\p{L}0-9]{1,3}\s+", ""), (r"^\p{Ll}{1,3}\s+(\p{Lu})", r"\1"), (r"^\p{Lu}\s+(\p{L})", r"\1"), (r"^\p{Lu}{2}\s+(\p{Lu}\p{Ll})", r"\1")):
        line = f"regexp_replace({line}, '{a}', '{b}')"
    return line


PREFIX = r"^((?:\S{1,8}\s+){2,5})(\p{Lu}\p{Ll}{3,})"
TOKENS = f"list_filter(list_transform(regexp_split_to_array(trim(regexp_extract(line, '{PREFIX}', 1)), '\\s+'), lambda x: lower(regexp_replace(x, '[^\\p{{L}}]', '', 'g'))), lambda x: length(x) >= 3)"
TAILS = (r'\s*[|(\[<>)\]+=#&"]{1,2}\s*[0-9\p{P}\s]{0,5}$', r"\s+(?:\p{L}{1,2}|[0-9])$")


@query(f"""WITH {JUDGED},
lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_ix, ls[i] AS raw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
a AS (SELECT doc_id, line_ix, {_edges('line')} AS line FROM judged WHERE NOT noise),
b AS (SELECT doc_id, line_ix, line, {TOKENS} AS toks FROM a),
o AS (SELECT doc_id, line_ix, line, len(toks) AS n, len(list_filter(toks, lambda w: NOT {NATURAL})) AS odd FROM b),
c AS (SELECT doc_id, line_ix, CASE WHEN length(line) > 30 AND n >= 2 AND odd / n::DOUBLE >= 0.6 THEN regexp_replace(line, '{PREFIX}', '\\2') ELSE line END AS line FROM o),
d AS (SELECT doc_id, line_ix, {TRIMMED.replace('line', f"regexp_replace(regexp_replace(line, '{TAILS[0]}', ''), '{TAILS[1]}', '')", 1)} AS line FROM c),
e AS (SELECT lines.doc_id, lines.line_ix, CASE WHEN j.line IS NULL THEN '' ELSE d.line END AS line
      FROM lines LEFT JOIN judged j ON j.doc_id = lines.doc_id AND j.line_ix = lines.line_ix LEFT JOIN d ON d.doc_id = lines.doc_id AND d.line_ix = lines.line_ix WHERE j.line IS NULL OR NOT j.noise)
SELECT doc_id, {TRIMMED.replace('line', "regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')", 1)} AS text
FROM (SELECT documents.doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_ix), '') AS t FROM documents LEFT JOIN e ON e.doc_id = documents.doc_id GROUP BY documents.doc_id)""")
def clean_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_ocr_noise(F.col("text")).alias("text"))


def _replaced(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, '{a}', '{b}')"
    return c


PLAIN = [x for x in text.WORD_SUBSTITUTIONS if not any(ch.isdigit() for ch in x[0])]
NUMERIC = [x for x in text.WORD_SUBSTITUTIONS if x not in PLAIN]
BARS = r"regexp_replace({0}, '(\p{{L}})\|(\p{{L}})', '\1l\2', 'g')"
LIGATURES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|\\PL)ﬁ', '\\1fi', 'g'), '(^|\\PL)ﬂ', '\\1fl', 'g'), '(^|\\PL)ﬀ', '\\1ff', 'g'), '(^|\\PL)ﬃ', '\\1ffi', 'g'), '(^|\\PL)ﬄ', '\\1ffl', 'g')"


@query(f"""
WITH t AS (SELECT doc_id, {BARS.format(BARS.format(LIGATURES))} AS text FROM documents),
p AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks, regexp_split_to_array(text, '\\S+') AS gaps FROM t),
u AS (SELECT doc_id, i, gaps[i] AS gap, toks[i] AS tok, length(regexp_replace(toks[i], '[^\\p{{L}}]', '', 'g')) AS n, length(regexp_replace(toks[i], '[^0-9]', '', 'g')) AS d
      FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM p)),
v AS (SELECT doc_id, i, gap, n, CASE WHEN d > n THEN {_replaced('tok', text.DIGIT_SUBSTITUTIONS)} WHEN n > d AND d > 0 THEN {_replaced('tok', NUMERIC)} ELSE tok END AS tok FROM u),
w AS (SELECT doc_id, i, gap, CASE WHEN n >= 3 THEN {_replaced('tok', PLAIN)} ELSE tok END AS tok FROM v)
SELECT doc_id, string_agg(gap || coalesce(tok, ''), '' ORDER BY i) AS text FROM w GROUP BY doc_id""")
def confusion_fix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fix_confusions(F.col("text")).alias("text"))


@query("""
SELECT doc_id, CASE WHEN length(s) >= 5 AND length(s) - length(replace(s, ' ', '')) >= 0.6 * length(replace(s, ' ', '')) AND regexp_matches(s, '^\\s?\\S\\s\\S\\s\\S')
  THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE s END AS text FROM (SELECT doc_id, text, regexp_replace(text, '(\\S)', '\\1 ', 'g') AS s FROM documents)""")
def cid_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_letter_spacing(F.regexp_replace("text", r"(\S)", "$1 ")).alias("text"))


#: By type its pattern for DuckDB, one whose first group is the match, and the value of the match `raw`; in the order of the rules.
ENTITY_SQL: dict[str, tuple] = {}


def _entity_query(name: str, pattern: str | None, within: str | None = None):
    """pattern: for DuckDB; within: one whose first group is the match, where a border has to be part of the pattern."""
    rule = next(r for r in text.ENTITY_RULES if r[0] == name)

    def run(spark, sf_dir):
        found = text.entities_of(F.col("text"), rule[1], rule[2], rule[3])
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("e")).groupBy("doc_id", "e.type", "e.raw", "e.value").agg(F.count("*").alias("n"))

    run.__name__ = f"entities_{rule[1]}"
    value = {"phone": r"regexp_replace(raw, '\s+', ' ', 'g')", "iban": r"upper(regexp_replace(raw, '[\s\-]', '', 'g'))", "siret": r"regexp_replace(raw, '[\s\-]', ' ', 'g')"}.get(rule[1], "raw")
    if rule[1] == "date":
        part = lambda k: f"regexp_extract(raw, '{pattern}', {k})"
        value = f"lpad({part(1)}, 2, '0') || '/' || lpad({part(2)}, 2, '0') || '/' || CASE WHEN length({part(3)}) = 2 THEN '20' || {part(3)} ELSE {part(3)} END"
    found = f"regexp_extract_all(text, '{within}', 1)" if within else f"regexp_extract_all(text, '{pattern}')"
    ENTITY_SQL[rule[1]] = pattern, within, value
    query(f"SELECT doc_id, '{rule[1]}' AS type, raw, {value} AS value, count(*) AS n FROM (SELECT doc_id, unnest({found}) AS raw FROM documents) GROUP BY ALL")(run)


# The patterns of entities in DuckDB's dialect.
S = r"[ \t\n\x0B\f\r]"
_entity_query("date_dmy_slash", rf"\b([0-9]{{1,2}}){S}*[/\-.]{S}*([0-9]{{1,2}}){S}*[/\-.]{S}*([0-9]{{2,4}})\b")
_entity_query("phone_international", r"(?:\+[0-9]{1,3}[\s\-]?)?\(?[0-9]{2,4}\)?[\s\-]?[0-9]{2,3}[\s\-]?[0-9]{2,3}[\s\-]?[0-9]{2,4}\b")
_entity_query("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
_entity_query("url", r"(?i)(?:https?://|www\.)[^\s<>\]]+")
_entity_query("amount", r"(?i)\b[0-9]{1,3}(?:[\s.,][0-9]{3})*(?:[,.][0-9]{1,2})?\s*(?:€|EUR|DA|USD|\$|£|MAD|DZD|TND)\b")
_entity_query("iban", r"\b[A-Z]{2}[0-9]{2}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}[\s\-]?[0-9A-Z]{4}(?:[\s\-]?[0-9A-Z]{1,4}){0,5}\b")
_entity_query("siret", r"\b[0-9]{3}[\s\-]?[0-9]{3}[\s\-]?[0-9]{3}[\s\-]?[0-9]{3}[\s\-]?[0-9]{2}\b")
_entity_query("reference", None, r"(?:^|[^\p{L}\p{N}_])((?i:R[ée]f|N°|Ref|Dossier)[\s.:]*[\p{L}\p{N}_\-/]+)")
_entity_query("spaced_number", r"\b(?:[0-9]{1,3}(?:\s[0-9]{3}){1,4})\b")


def _listed(entities: str) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat(e["type"], F.lit(":"), e["raw"], F.lit(">"), e["value"])), "\n")


def _all_entities() -> str:
    """DuckDB: the rules one after the other; each finds its matches and those that normalise put them in place of what they found."""
    steps = ["t0 AS (SELECT doc_id, text, CAST([] AS VARCHAR[]) AS found FROM documents)"]
    for k, (kind, (pattern, within, value)) in enumerate(ENTITY_SQL.items()):
        met = f"regexp_extract_all(text, '{within}', 1)" if within else f"regexp_extract_all(text, '{pattern}')"
        gaps = f"regexp_split_to_array(text, '{pattern}')"
        normal = value.replace("raw", "x")
        text_after = "text" if value == "raw" else f"CASE WHEN len(raws) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(raws) + 2), lambda i: ({gaps})[i] || coalesce(vals[i], '')), '') END"
        steps.append(f"m{k} AS (SELECT doc_id, text, found, {met} AS raws FROM t{k}), v{k} AS (SELECT *, list_transform(raws, lambda x: {normal}) AS vals FROM m{k})")
        steps.append(f"t{k + 1} AS (SELECT doc_id, {text_after} AS text, list_concat(found, list_transform(range(1, len(raws) + 1), lambda i: '{kind}:' || raws[i] || '>' || vals[i])) AS found FROM v{k})")
    return f"WITH {', '.join(steps)} SELECT doc_id, text AS rewritten, array_to_string(found, chr(10)) AS entities FROM t{len(ENTITY_SQL)}"


@query(_all_entities())
def entities_all(spark, sf_dir):
    """All rules in their order, each on what the one before has made of the text; entities as `type:raw>value`, a line each."""
    out = text.with_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("text").alias("rewritten"), _listed("entities").alias("entities"))



@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, {TRIMMED} AS line, regexp_replace({TRIMMED}, '[^\\p{{L}}]', '', 'g') AS ls FROM l),
c AS (SELECT doc_id, CASE WHEN line = '' THEN 'blank'
  WHEN length(ls) >= 4 AND length(line) <= 50 AND NOT regexp_matches(line, '[0-9]{{2,}}') AND NOT regexp_matches(line, ':\\s+') AND upper(ls) = ls
       AND len(regexp_split_to_array(line, '\\s+')) >= 2 THEN 'heading'
  WHEN regexp_matches(line, '^(?:(?:[0-9]{{1,3}}|[a-zA-Z])[.)\\-]|[\\-*•–])\\s+.+$') THEN 'list'
  WHEN regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[\\-=_*]{{3,}}$') THEN 'separator' ELSE 'paragraph' END AS kind FROM t)
SELECT doc_id, kind, count(*) AS n FROM c GROUP BY doc_id, kind""")
def line_classes(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.split("text", "\n", -1), trim)).alias("line"))
    return lines.groupBy("doc_id", text.line_class(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


#: DuckDB: trimmed lines with their class, their heading's level and the class of the line before.
CLASSED = f"""
l AS (SELECT doc_id, i AS line_ix, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, line_ix, {TRIMMED} AS line, regexp_replace({TRIMMED}, '[^\\p{{L}}]', '', 'g') AS ls FROM l),
h AS (SELECT *, CASE WHEN length(ls) >= 4 AND length(line) <= 50 AND NOT regexp_matches(line, '[0-9]{{2,}}') AND NOT regexp_matches(line, ':\\s+') AND upper(ls) = ls
       AND len(regexp_split_to_array(line, '\\s+')) >= 2 THEN CASE WHEN length(line) <= 30 THEN 2 ELSE 3 END ELSE 0 END AS level FROM t),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN level > 0 THEN 'heading'
  WHEN regexp_matches(line, '^(?:(?:[0-9]{{1,3}}|[a-zA-Z])[.)\\-]|[\\-*•–])\\s+.+$') THEN 'list'
  WHEN regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[\\-=_*]{{3,}}$') THEN 'separator' ELSE 'paragraph' END AS kind FROM h),
c AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_ix) AS before FROM k)"""
TITLE = "array_to_string(list_transform(string_split(lower(line), ' '), lambda w, i: CASE WHEN i = 1 OR length(w) > 3 THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ')"


@query(f"""WITH {CLASSED},
e AS (SELECT doc_id, line_ix, CASE WHEN kind = 'paragraph' AND before = 'paragraph' THEN chr(10) ELSE chr(10) || chr(10) END
  || CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || {TITLE} WHEN 'separator' THEN '---' ELSE line END AS part FROM c WHERE kind <> 'blank')
SELECT d.doc_id, coalesce(ltrim(string_agg(part, '' ORDER BY line_ix), chr(10)), '') AS markdown FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id""")
def structure_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.structured(F.col("text")).alias("markdown"))


@query(f"""WITH {CLASSED},
s AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_ix) AS shown FROM c WHERE kind <> 'blank'),
b AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND before = 'paragraph' OR kind = 'list' AND shown = 'list' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_ix) - 1 AS block_ix FROM s)
SELECT doc_id, CAST(block_ix AS BIGINT) AS block_ix, any_value(kind) AS type, max(level) AS level, CASE WHEN any_value(kind) = 'separator' THEN '' ELSE string_agg(line, chr(10) ORDER BY line_ix) END AS lines
FROM b GROUP BY doc_id, block_ix""")
def structure_blocks(spark, sf_dir):
    blocks = text.structure_blocks(table(spark, sf_dir, "documents"), "doc_id")
    return blocks.withColumn("lines", F.array_join("lines", "\n"))


@query(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda line: {TRIMMED}), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph_ix, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)""")
def paragraphs_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("paragraph_ix", "paragraph"))


MIN_FREQUENCY = 100
#: DuckDB: words with themselves and with each character left out; two words one edit apart share one of these.
LEFT_OUT = "SELECT word, {1}, unnest(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS v FROM {0}"


@query(f"""
WITH known AS (SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word),
unknown AS (SELECT DISTINCT word FROM (SELECT unnest({WORDS}) AS word FROM conversations) WHERE length(word) >= 5 AND word NOT IN (SELECT word FROM known)),
near AS (SELECT DISTINCT a.word, b.word AS candidate, b.freq, levenshtein(a.word, b.word) AS dist FROM ({LEFT_OUT.format('unknown', '0 AS freq')}) a JOIN ({LEFT_OUT.format('known', 'freq')}) b ON a.v = b.v
  WHERE abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) <= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, candidate) AS r FROM near)
SELECT word, candidate AS suggestion FROM best WHERE r = 1 AND freq >= {MIN_FREQUENCY}""")
def spell_candidates(spark, sf_dir):
    """Unknown words against the whole dictionary; the best candidate counts if it is frequent."""
    known = train.dictionary(table(spark, sf_dir, "documents"))
    words = train.dictionary(table(spark, sf_dir, "conversations")).where(F.length("word") >= 5).join(known.select("word"), "word", "left_anti")
    return correct.closest(words, known, 1, MIN_FREQUENCY)


#: DuckDB: the tokens with a letter of each line of the conversations, with what stands before them, their letters and their neighbours.
TALK = r"""
talk AS (SELECT conv_id || ':' || turn AS doc_id, text FROM conversations),
tl AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_ix FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM talk)),
tp AS (SELECT doc_id, line_ix, regexp_extract_all(line, '\S*\p{L}\S*') AS toks, regexp_split_to_array(line, '\S*\p{L}\S*') AS gaps FROM tl),
tk AS (SELECT doc_id, line_ix, i, gaps[i] AS gap, toks[i] AS tok, regexp_replace(toks[i], '[^\p{L}]', '', 'g') AS w, len(toks) AS n,
  CASE WHEN i > 1 THEN toks[i - 1] END AS before, toks[i + 1] AS after, CASE WHEN i > 1 THEN regexp_replace(toks[i - 1], '[^\p{L}]', '', 'g') END AS bw, regexp_replace(toks[i + 1], '[^\p{L}]', '', 'g') AS aw
  FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM tp))"""
LIKE = r"CASE WHEN upper(w) = w THEN upper({0}) WHEN regexp_matches(w, '^\p{{Lu}}') THEN upper(substr({0}, 1, 1)) || substr({0}, 2) ELSE {0} END"


def _as_text(corrections: str) -> Column:
    """`from>to` of each correction, in order."""
    return F.array_join(F.transform(corrections, lambda c: F.concat(c["from"], F.lit(">"), c["to"])), ",")


@query(f"""
WITH {TALK},
known AS (SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 2),
asked AS (SELECT DISTINCT lower(w) AS word FROM tk WHERE length(w) >= 5 AND lower(w) NOT IN (SELECT word FROM known)),
near AS (SELECT DISTINCT a.word, b.word AS candidate, b.freq, levenshtein(a.word, b.word) AS dist FROM ({LEFT_OUT.format('asked', '0 AS freq')}) a JOIN ({LEFT_OUT.format('known', 'freq')}) b ON a.v = b.v
  WHERE abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) <= 1),
best AS (SELECT word, candidate FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, candidate) AS r FROM near) WHERE r = 1 AND freq >= 100),
fixed AS (SELECT tk.*, CASE WHEN length(w) >= 5 AND NOT (regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}') AND (coalesce(regexp_matches(before, '^\\p{{Lu}}'), false) OR coalesce(regexp_matches(after, '^\\p{{Lu}}\\p{{Ll}}'), false))) THEN {LIKE.format('candidate')} END AS new
  FROM tk LEFT JOIN best ON best.word = lower(w)),
lines AS (SELECT doc_id, line_ix, string_agg(gap || coalesce(CASE WHEN new IS NULL THEN tok ELSE replace(tok, w, new) END, ''), '' ORDER BY i) AS line FROM fixed GROUP BY doc_id, line_ix),
made AS (SELECT doc_id, string_agg(w || '>' || new, ',' ORDER BY line_ix, i) AS corrections FROM fixed WHERE new IS NOT NULL GROUP BY doc_id)
SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_ix) AS text, coalesce(any_value(corrections), '') AS corrections FROM lines l LEFT JOIN made ON made.doc_id = l.doc_id GROUP BY l.doc_id""")
def spell_correct(spark, sf_dir):
    known = train.filter_by_frequency(train.dictionary(table(spark, sf_dir, "documents")), 2, 2)
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return correct.spell_correct(talk, known).withColumn("corrections", _as_text("corrections"))


@query(f"""
WITH {TALK},
u AS (SELECT word, count(*) AS freq FROM (SELECT unnest({NGRAM_WORDS}) AS word FROM documents) GROUP BY word),
b AS (SELECT w1, w2, count(*) AS n FROM ({PAIRS}) GROUP BY w1, w2),
one AS (SELECT sum(freq) AS total FROM u),
ctx AS (SELECT *, lower(w) AS word, lower(bw) AS p, lower(aw) AS nx, n >= 2 AND length(w) >= 4 AND NOT (regexp_matches(w, '^\\p{{Lu}}') AND NOT (upper(w) = w AND length(w) > 3)
  AND (coalesce(regexp_matches(bw, '^\\p{{Lu}}'), false) OR coalesce(regexp_matches(aw, '^\\p{{Lu}}'), false))) AS asked FROM tk),
cases AS (SELECT DISTINCT word, p, nx FROM ctx WHERE asked AND word NOT IN (SELECT word FROM u)),
words AS (SELECT DISTINCT word FROM cases),
near AS (SELECT DISTINCT x.word, y.word AS candidate, y.freq FROM ({LEFT_OUT.format('words', '0 AS freq')}) x JOIN ({LEFT_OUT.format('u', 'freq')}) y ON x.v = y.v
  WHERE abs(length(x.word) - length(y.word)) <= 1 AND levenshtein(x.word, y.word) = 1),
scored AS (SELECT c.word, c.p, c.nx, candidate, near.freq, near.freq / total::DOUBLE + CASE WHEN fp.freq > 0 THEN 2 * coalesce(b1.n, 0) / fp.freq::DOUBLE ELSE 0 END + 2 * coalesce(b2.n, 0) / near.freq::DOUBLE AS score, 5.0 / total AS least
  FROM cases c JOIN near ON near.word = c.word CROSS JOIN one LEFT JOIN u fp ON fp.word = c.p LEFT JOIN b b1 ON b1.w1 = c.p AND b1.w2 = candidate LEFT JOIN b b2 ON b2.w1 = candidate AND b2.w2 = c.nx),
best AS (SELECT word, p, nx, candidate FROM (SELECT *, row_number() OVER (PARTITION BY word, p, nx ORDER BY score DESC, freq DESC, candidate) AS r FROM scored WHERE score > least) WHERE r = 1),
fixed AS (SELECT ctx.*, CASE WHEN asked THEN candidate END AS new FROM ctx LEFT JOIN best ON best.word = ctx.word AND best.p IS NOT DISTINCT FROM ctx.p AND best.nx IS NOT DISTINCT FROM ctx.nx),
lines AS (SELECT doc_id, line_ix, string_agg(gap || coalesce(CASE WHEN new IS NULL THEN tok ELSE {LIKE.format('new')} END, ''), '' ORDER BY i) AS line FROM fixed GROUP BY doc_id, line_ix),
made AS (SELECT doc_id, string_agg(w || '>' || new, ',' ORDER BY line_ix, i) AS ngram_corrections FROM fixed WHERE new IS NOT NULL GROUP BY doc_id)
SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_ix) AS text, coalesce(any_value(ngram_corrections), '') AS ngram_corrections FROM lines l LEFT JOIN made ON made.doc_id = l.doc_id GROUP BY l.doc_id""")
def ngram_correct(spark, sf_dir):
    model = train.NgramModel.train(table(spark, sf_dir, "documents"))
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return correct.ngram_correct(talk, model).withColumn("ngram_corrections", _as_text("ngram_corrections"))


def _layers() -> str:
    """DuckDB: the SQL of the layers, each over what the one before gives."""
    of = lambda name, source: re.sub(r"\bdocuments\b", source, SQL[name])
    spelling = SQL["spell_correct"].replace("conv_id || ':' || turn AS doc_id, text FROM conversations", "doc_id, text FROM d2")
    return f"""WITH d1 AS ({SQL['clean_noise']}), d2 AS ({of('confusion_fix', 'd1')}), d3 AS ({spelling}),
d4 AS (SELECT doc_id, rewritten AS text, entities FROM ({of('entities_all', 'd3')})), d5 AS ({of('structure_markdown', 'd4')})
SELECT d5.doc_id, markdown AS text, corrections, entities FROM d5 JOIN d3 ON d3.doc_id = d5.doc_id JOIN d4 ON d4.doc_id = d5.doc_id"""


@query(_layers())
def pipeline_layers(spark, sf_dir):
    """Noise, confusions, spelling, entities and structure as one pipeline."""
    from ..plans.pipeline import from_config

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = train.filter_by_frequency(train.dictionary(docs), 2, 2)
    layers = from_config({"spell_correction": {"enabled": True}}, dictionary=known)
    out = layers(docs.withColumn("text", text.clean_ocr_noise(F.col("text"))))
    return out.select("doc_id", "text", _as_text("corrections").alias("corrections"), _listed("entities").alias("entities"))


@query(f"""
WITH t AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
g AS (SELECT conv_id, turn, m, coalesce(CAST(n < 80 AND before > 100 AS INTEGER), 0) AS new FROM t)
SELECT conv_id, turn, CAST(CASE WHEN m <= 3 THEN 0 ELSE sum(new) OVER (PARTITION BY conv_id ORDER BY turn) END AS INTEGER) AS slide_ix FROM g""")
def slide_grouping(spark, sf_dir):
    from ..operators.layout import slide_groups

    return slide_groups(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "slide_ix")


@query("SELECT quality, toxic, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def text_by_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word")
def stream_dictionary(spark, sf_dir):
    """The dictionary kept by a stream over the documents' files, run until all of them are counted."""
    from .. import scratch, streaming

    root = scratch.fresh(spark, "stream-dictionary")
    docs = table(spark, sf_dir, "documents")
    path = f"{sf_dir}/documents.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(docs.schema).format("parquet")
    stream = reader.load(path) if folder else reader.option("pathGlobFilter", "documents.parquet").load(sf_dir)
    run = streaming.keep_dictionary(stream, f"{root}/counts", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return streaming.dictionary_of(spark, f"{root}/counts")
