"""Queries that show one ability each on rows of the tables: styles, metadata, images, files, dictionaries, scalars, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import model, scratch, sinks, sources
from ..operators import correct, layout, text, train
from .corpus import WORDS, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parsed(rows: DataFrame, key: str, made: Column, extension: str, **options) -> DataFrame:
    """Documents of a text made for each row, named `<key>.<extension>`."""
    files = sources.spread(rows).select(F.concat(F.col(key).cast("string"), F.lit(f".{extension}")).alias("path"), F.encode(made, "UTF-8").alias("content"))
    return sources.parse_files(files, **options)


def key_of(c: str = "doc_id") -> Column:
    return F.split_part(c, F.lit("."), F.lit(1)).cast("long")


# CSV


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, is_header, a, b FROM (SELECT s_suppkey, false AS is_header, s_name || ';' || s_suppkey AS a, 'it''s' AS b FROM supplier UNION ALL SELECT s_suppkey, false, 'x', CAST(s_suppkey * 2 AS VARCHAR) FROM supplier)")
def csv_options(spark, sf_dir):
    """Another delimiter, another quotation mark that is doubled inside, no header."""
    made = F.concat(F.lit("'"), F.col("s_name"), F.lit(";"), F.col("s_suppkey"), F.lit("';'it''s'\nx;"), F.col("s_suppkey") * 2)
    docs = parsed(table(spark, sf_dir, "supplier"), "s_suppkey", made, "csv", delimiter=";", enclosure="'", header=False)
    return model.table_rows(docs).select(key_of().alias("key"), "is_header", F.col("cells")[0]["text"].alias("a"), F.col("cells")[1]["text"].alias("b"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, CAST(3 AS INTEGER) AS n_rows, '5' AS rows_left_out FROM supplier")
def csv_limit(spark, sf_dir):
    """A limit keeps so many rows and says how many it left out."""
    docs = parsed(table(spark, sf_dir, "supplier"), "s_suppkey", F.concat_ws("\n", *[F.concat(F.col("s_name"), F.lit(f",{k}")) for k in range(8)]), "csv", limit=3)
    return docs.select(key_of().alias("key"), F.size(F.col("sections")[0]["elements"][0]["table"]["rows"]).alias("n_rows"), F.col("metadata")["rows_left_out"].alias("rows_left_out"))


# HTML styles


@query("""SELECT CAST(c_custkey AS BIGINT) AS key, 'center' AS alignment, (c_custkey % 20) * 0.75::DOUBLE AS space_before, 'Georgia' AS font_family, (c_custkey % 30 + 6)::DOUBLE AS font_size,
  '#00' || (c_custkey % 10) || 'abc' AS color, c_custkey % 2 = 0 AS bold, true AS underline, '#111111' AS border_color, (c_custkey % 3)::DOUBLE AS border_width, 'dashed' AS border_style, c_name AS text FROM customer""")
def css_styles(spark, sf_dir):
    k = F.col("c_custkey")
    made = F.concat(F.lit('<body><p style="text-align:center; margin-top:'), k % 20, F.lit("px\"><span style=\"font-family:'Georgia', serif; FONT-SIZE: "), k % 30 + 6, F.lit("pt; color:#00"), k % 10, F.lit("abc; font-weight:"), F.when(k % 2 == 0, "bold").otherwise("normal"), F.lit('; text-decoration:underline">'), F.col("c_name"), F.lit('</span></p><table style="border-color:#111111;border-width:'), k % 3, F.lit('pt;border-style:dashed"><tr><td>x</td></tr></table></body>'))
    docs = parsed(table(spark, sf_dir, "customer"), "c_custkey", made, "html").select(key_of().alias("key"), F.col("sections")[0]["elements"].alias("e"))
    p, t, r = F.col("e")[0]["paragraph"], F.col("e")[1]["table"], F.col("e")[0]["paragraph"]["runs"][0]
    return docs.select("key", *[p["style"][c].alias(c) for c in ("alignment", "space_before")], *[r["style"][c].alias(c) for c in ("font_family", "font_size", "color", "bold", "underline")], *[t["style"][c].alias(c) for c in ("border_color", "border_width", "border_style")], r["text"].alias("text"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS key, k AS part, CASE k WHEN 0 THEN 'plain ' WHEN 1 THEN c_name WHEN 2 THEN 'both' ELSE chr(10) END AS text, CASE WHEN k IN (1, 2) THEN true END AS bold, CASE k WHEN 1 THEN false WHEN 2 THEN true END AS italic
FROM (SELECT *, unnest([0, 1, 2, 3])::INTEGER AS k FROM customer)""")
def inline_marks(spark, sf_dir):
    """Runs of nested inline tags: each text once, with the marks of all tags around it."""
    made = F.concat(F.lit("<body><p>plain <b>"), F.col("c_name"), F.lit("<i>both</i></b><br></p></body>"))
    return model.runs(parsed(table(spark, sf_dir, "customer"), "c_custkey", made, "html")).select(key_of().alias("key"), F.col("run_ix").alias("part"), "text", F.col("style.bold").alias("bold"), F.col("style.italic").alias("italic"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS key, CAST(2 AS INTEGER) AS n_columns, CAST(p_partkey % 5 + 1 AS INTEGER) AS colspan, true AS is_header FROM part""")
def html_spans(spark, sf_dir):
    """A header's span, and the cells of the longest row."""
    made = F.concat(F.lit('<body><table><thead><tr><th colspan="'), F.col("p_partkey") % 5 + 1, F.lit('">a</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table></body>'))
    t = F.col("sections")[0]["elements"][0]["table"]["rows"]
    return parsed(table(spark, sf_dir, "part"), "p_partkey", made, "html").select(key_of().alias("key"), model.column_count(t).alias("n_columns"), t[0]["cells"][0]["colspan"].alias("colspan"), t[0]["is_header"].alias("is_header"))


# Markdown

PAGE = ("---\ntitre: ", "\nauteur: Ann\nville: Rome\n---\n# Head ", "\n\nplain **fat** and *thin* `code`\n\n- one\n- two\n\n> said\n> so\n\n```\nx = 1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![alt](/p.png)\n")


def markdown_pages(spark, sf_dir) -> DataFrame:
    return parsed(table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit(PAGE[0]), F.col("c_name"), F.lit(PAGE[1]), F.col("c_custkey"), F.lit(PAGE[2])), "md")


@query("SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS title, 'Ann' AS author, 'Rome' AS city FROM customer")
def front_matter(spark, sf_dir):
    return markdown_pages(spark, sf_dir).select(key_of().alias("key"), "title", F.col("metadata")["author"].alias("author"), F.col("metadata")["ville"].alias("city"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS key, CAST(i AS INTEGER) AS element_ix, CASE i WHEN 6 THEN 'table' WHEN 7 THEN 'image' ELSE 'paragraph' END AS type,
  CASE i WHEN 0 THEN 'Head ' || c_custkey WHEN 1 THEN 'plain fat and thin code' WHEN 2 THEN '• one' WHEN 3 THEN '• two' WHEN 4 THEN '« said so »' WHEN 5 THEN 'x = 1' END AS text, CASE WHEN i = 0 THEN 1 END::INTEGER AS level
FROM (SELECT c_custkey, unnest(range(0, 8)) AS i FROM customer)""")
def markdown_blocks(spark, sf_dir):
    """Headings, paragraphs, lists, quotations, code, tables and pictures of Markdown."""
    return model.elements(markdown_pages(spark, sf_dir)).select(key_of().alias("key"), "element_ix", "type", "text", F.col("paragraph.style.heading_level").alias("level"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS key, run_ix, ['plain ', 'fat', ' and ', 'thin', ' ', 'code'][run_ix + 1] AS text, coalesce(run_ix = 1, false) AS bold, coalesce(run_ix = 3, false) AS italic FROM (SELECT c_custkey, CAST(unnest(range(0, 6)) AS INTEGER) AS run_ix FROM customer)""")
def markdown_marks(spark, sf_dir):
    runs = model.runs(markdown_pages(spark, sf_dir)).where("element_ix = 1")
    return runs.select(key_of().alias("key"), "run_ix", "text", F.coalesce("style.bold", F.lit(False)).alias("bold"), F.coalesce("style.italic", F.lit(False)).alias("italic"))


# Containers: properties, styles and pictures that come back


def again(docs: DataFrame, fmt: str, **options) -> DataFrame:
    made = sinks.render(docs, fmt).select(F.concat(F.split_part("doc_id", F.lit("."), F.lit(1)), F.lit(f".{fmt}")).alias("doc_id"), "content")
    return sources.parse_files(made, "doc_id", "content", **options)


CONTAINERS = ("docx", "xlsx", "pptx", "doc", "xls", "ppt")


@query(f"SELECT CAST(s_suppkey AS BIGINT) AS key, unnest([{', '.join(repr(f) for f in CONTAINERS)}]) AS format, s_name AS title, 'Ann' AS author FROM supplier")
def container_properties(spark, sf_dir):
    """Title and author through the properties of six containers."""
    docs = parsed(table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("---\ntitle: "), F.col("s_name"), F.lit("\nauthor: Ann\n---\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")), "md")
    out = None
    for fmt in CONTAINERS:
        one = again(docs, fmt).select(key_of().alias("key"), F.lit(fmt).alias("format"), "title", F.col("metadata")["author"].alias("author"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT CAST(s_suppkey AS BIGINT) AS key, element_ix, [2, NULL][element_ix + 1]::INTEGER AS level, ['Part ' || s_suppkey, 'fat' || 'red'][element_ix + 1] AS text, element_ix = 1 AS has_bold, element_ix = 1 AS has_red
FROM (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS element_ix FROM supplier)""")
def docx_styles(spark, sf_dir):
    """Headings and styled runs through DOCX."""
    made = F.concat(F.lit("<body><h2>Part "), F.col("s_suppkey"), F.lit('</h2><p><b>fat</b><span style="color:#ff0000">red</span></p></body>'))
    e = model.elements(again(parsed(table(spark, sf_dir, "supplier"), "s_suppkey", made, "html"), "docx"))
    runs = F.col("paragraph.runs")
    return e.select(key_of().alias("key"), "element_ix", F.col("paragraph.style.heading_level").alias("level"), "text", (F.exists(runs, lambda r: (r["text"] == "fat") & r["style"]["bold"])).alias("has_bold"), F.exists(runs, lambda r: (r["text"] == "red") & (F.lower(r["style"]["color"]) == "#ff0000")).alias("has_red"))


# Files and folders


@query("SELECT 'sub' || (s_suppkey % 3) || '/' || s_suppkey || '.md' AS path, s_name AS title, CAST(1 AS INTEGER) AS n_sections FROM supplier")
def files_saved_and_opened(spark, sf_dir):
    """Documents written as files in folders, walked, opened in one batch and named by their path."""
    from ..plans import manager

    folder = scratch.fresh(spark, "saved")
    rows = table(spark, sf_dir, "supplier").withColumn("name", F.concat(F.lit("sub"), F.col("s_suppkey") % 3, F.lit("/"), F.col("s_suppkey")))
    docs = parsed(rows, "name", F.concat(F.lit("---\ntitle: "), F.col("s_name"), F.lit("\n---\nhello\n")), "md").withColumn("doc_id", F.concat(F.lit("/base/"), F.col("doc_id")))
    docs = docs.withColumn("metadata", F.create_map(F.lit("title"), F.col("title")))
    manager.save(docs, folder, "md", base="/base").write.format("noop").mode("overwrite").save()
    back = manager.open_batch(spark, folder)
    return back.select(F.regexp_extract("doc_id", "(sub[0-9]+/[^/]+)$", 1).alias("path"), "title", F.size("sections").alias("n_sections"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3")
def dictionary_saved_and_loaded(spark, sf_dir):
    path = scratch.fresh(spark, "dictionary")
    train.save_dictionary(train.filter_by_frequency(train.dictionary(table(spark, sf_dir, "documents")), 3, 2), path)
    return train.load_dictionary(spark, path)


@query(f"""WITH d AS (SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM conversations) GROUP BY word)
SELECT word, freq FROM d WHERE word NOT IN ('the', 'zzyzx') UNION ALL SELECT * FROM (VALUES ('the', 7::BIGINT), ('zzyzx', 5::BIGINT)) AS t(word, freq)""")
def dictionary_edited(spark, sf_dir):
    return train.add_words(train.dictionary(table(spark, sf_dir, "conversations")), {"The": 7, "zzyzx": 5})


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}'']+'), lambda w: length(w) >= 2) AS ws FROM conversations),
u AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word)
SELECT word, round(n / (SELECT sum(n) FROM u)::DOUBLE, 10) AS score FROM u""")
def ngram_model_saved_and_loaded(spark, sf_dir):
    path = scratch.fresh(spark, "model")
    train.NgramModel.train(table(spark, sf_dir, "conversations")).save(path)
    model_ = train.NgramModel.load(spark, path)
    return model_.score_words(model_.unigrams.select("word")).withColumn("score", F.round("score", 10))


# Texts


@query("""SELECT CAST(o_orderkey AS BIGINT) AS key, 'order' AS type, 'Bon-' || o_orderkey AS raw, 'BON ' || o_orderkey AS value, 'see BON ' || o_orderkey || ' of ' || o_custkey AS rewritten FROM orders""")
def custom_rules(spark, sf_dir):
    """A rule of one's own after the usual ones, which rewrites what it finds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("see Bon-"), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey")).alias("text"))
    rule = ("order", "order", r"\bBon-[0-9]+", lambda m: F.upper(F.replace(m, F.lit("-"), F.lit(" "))))
    out = text.with_entities(rows, rules=(), custom=(rule,))
    return out.select(F.col("o_orderkey").cast("long").alias("key"), F.explode("entities").alias("e"), F.col("text").alias("rewritten")).select("key", "e.type", "e.raw", "e.value", "rewritten")


@query("SELECT CAST(p_partkey AS BIGINT) AS key, CASE p_partkey % 3 WHEN 0 THEN 'MAISON' WHEN 1 THEN 'Maison' ELSE 'maison' END AS matched FROM part")
def matched_case(spark, sf_dir):
    like = F.when(F.col("p_partkey") % 3 == 0, "MAISSON").when(F.col("p_partkey") % 3 == 1, "Maisson").otherwise("maisson")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), fn.match_case(like, F.lit("maison")).alias("matched"))


@query("SELECT CAST(p_partkey AS BIGINT) AS key, 'a' || chr(9) || p_name || chr(10) || 'b' AS text FROM part")
def control_stripped(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), text.strip_control(F.concat(F.lit("a\x00\t"), F.col("p_name"), F.lit("\x07\r\nb\x1f"))).alias("text"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, CASE n_nationkey % 3 WHEN 0 THEN 'fra' WHEN 1 THEN 'rus' ELSE 'eng' END AS language FROM nation")
def script_languages(spark, sf_dir):
    """The language of an engine's script where the text speaks for none, and of the text where it does."""
    n = F.col("n_nationkey") % 3
    said = text.detect_language(F.when(n == 0, "le garçon a été là").otherwise("no marks in here"))
    script = text.script_language(F.when(n == 1, "Cyrillic").otherwise("Latin"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.when(said != "eng", said).otherwise(script).alias("language"))


@query(f"""WITH d AS (SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM conversations) GROUP BY word),
k AS (SELECT word, freq FROM d WHERE freq >= 20), u AS (SELECT word FROM d WHERE freq < 20 AND length(word) >= 5),
near AS (SELECT u.word, k.word AS candidate, k.freq, levenshtein(u.word, k.word) AS dist FROM u JOIN k ON abs(length(u.word) - length(k.word)) <= 2 WHERE levenshtein(u.word, k.word) <= 2)
SELECT word, candidate AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, candidate) AS r FROM near) WHERE r = 1 AND freq >= 30""")
def spell_candidates_two_edits(spark, sf_dir):
    """Suggestions within two edits."""
    words = train.dictionary(table(spark, sf_dir, "conversations"))
    return correct.closest(words.where("freq < 20 AND length(word) >= 5"), words.where("freq >= 20"), 2, 30)


# Scalars


@query("""SELECT CAST(n_nationkey AS BIGINT) AS key, 'word/media/image' || n_nationkey || '.png' AS beside, 'media/x.png' AS rooted, (n_nationkey + 1) / 20.0::DOUBLE AS from_twips, CAST(round((n_nationkey + 1) * 1000 / 9525.0) AS INTEGER) AS pixels,
  (n_nationkey + 1) / 2.0::DOUBLE AS from_half, (n_nationkey + 1) * 0.75::DOUBLE AS from_px, (n_nationkey + 1) * 12.0::DOUBLE AS from_em FROM nation""")
def paths_and_units(spark, sf_dir):
    k = F.col("n_nationkey") + 1
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("key"),
        fn.resolve_path(F.lit("word/charts/chart.xml"), F.concat(F.lit("../media/image"), F.col("n_nationkey"), F.lit(".png"))).alias("beside"),
        fn.resolve_path(F.lit("word/document.xml"), F.lit("/media/x.png")).alias("rooted"),
        fn.twips_to_points(k).alias("from_twips"), fn.emu_to_pixels(k * 1000).alias("pixels"), fn.half_points(k).alias("from_half"),
        fn.points(F.concat(k, F.lit("px"))).alias("from_px"), fn.points(F.concat(k, F.lit("em"))).alias("from_em"),
    )


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, substr('a_b_' || s_name || '_the rest of a long name', 1, 31) AS name FROM supplier")
def sheet_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), fn.sheet_name(F.concat(F.lit("a/?b:"), F.col("s_name"), F.lit("[the rest of a long name"))).alias("name"))


@query("""WITH RECURSIVE w AS (SELECT conv_id || ':' || turn AS doc_id, string_split(text, ' ') AS ws FROM conversations),
f AS (SELECT doc_id, ws, 1 AS i, '' AS line, CAST([] AS VARCHAR[]) AS lines FROM w
  UNION ALL SELECT doc_id, ws, i + 1, CASE WHEN length(CASE WHEN line = '' THEN ws[i] ELSE line || ' ' || ws[i] END) * 5.5 > 200 AND line <> '' THEN ws[i] WHEN line = '' THEN ws[i] ELSE line || ' ' || ws[i] END,
    CASE WHEN length(CASE WHEN line = '' THEN ws[i] ELSE line || ' ' || ws[i] END) * 5.5 > 200 AND line <> '' THEN list_append(lines, line) ELSE lines END FROM f WHERE i <= len(ws))
SELECT doc_id, array_to_string(CASE WHEN line <> '' THEN list_append(lines, line) WHEN len(lines) = 0 THEN [''] ELSE lines END, chr(10)) AS wrapped FROM f WHERE i = len(ws) + 1""")
def wrapped_lines(spark, sf_dir):
    """Greedy lines of 200 points, as the page writer makes them."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), F.array_join(fn.wrap(F.col("text"), "Helvetica", 10.0, 200.0), "\n").alias("wrapped"))


@query("""WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x FROM embeddings),
s AS (SELECT label, vec_id, x, coalesce(CAST(x - lag(x) OVER (PARTITION BY label ORDER BY x, vec_id) > 40 AS INTEGER), 0) AS new FROM p),
c AS (SELECT label, x, sum(new) OVER (PARTITION BY label ORDER BY x, vec_id) AS k FROM s),
f AS (SELECT label, k, min(x) AS x FROM c GROUP BY label, k), g AS (SELECT label, k, x - lag(x) OVER (PARTITION BY label ORDER BY k) AS step FROM f)
SELECT label, count(*) AS n_clusters FROM g GROUP BY label HAVING count(*) >= 3 AND max(step) <= 300""")
def table_like_lines(spark, sf_dir):
    """Lines of at least three clusters, none over 300 from the next."""
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0].cast("double") * 1000).alias("x"))
    return layout.table_like_lines(layout.x_clusters(points, ["label"], order="vec_id"), ["label"]).select("label", "n_clusters")


# Providers, with stand-ins


@query("SELECT page_id, mode, CASE mode WHEN 'none' THEN 0 WHEN 'all' THEN CAST(page_id % 25 > 0 AS INTEGER) ELSE CAST(page_id % 25 > 0 AND (page_id // 25 % 4) / greatest(page_id % 25 + page_id // 25 % 4, 1)::DOUBLE < 0.1 AS INTEGER) END AS sections FROM (SELECT page_id, unnest(['none', 'all', 'auto']) AS mode FROM pages)")
def ocr_modes(spark, sf_dir):
    """Sections that the modes of OCR choose: none, all with pictures, those with little text."""
    from ..providers import ocr

    n = F.col("page_id")
    made = F.concat(F.lit("<body>"), F.repeat(F.lit('<img src="s.png">'), (n % 25).cast("int")), F.repeat(F.lit("<p>Legende</p>"), (F.floor(n / 25) % 4).cast("int")), F.lit("</body>"))
    docs = parsed(table(spark, sf_dir, "pages"), "page_id", made, "html")
    out = None
    for mode, value in (("none", False), ("all", True), ("auto", "auto")):
        chosen = ocr.sections_to_read(docs, value).select("doc_id").withColumn("one", F.lit(1))
        part = docs.select("doc_id").join(chosen, "doc_id", "left").select(key_of().alias("page_id"), F.lit(mode).alias("mode"), F.coalesce("one", F.lit(0)).alias("sections"))
        out = part if out is None else out.unionByName(part)
    return out


class Proofreader:
    """A stand-in for a language model: answers with the text in capitals, or with a page of one title and one table."""

    def ask(self, prompt: str, image: bytes | None = None, mime_type: str = "image/png") -> str:
        body = prompt.split("---\n", 1)[1].rsplit("\n---", 1)[0]
        return f'Here: {{"title": "{body}", "paragraphs": ["one", ""], "tables": [[["a"], ["{body}"]]], "confidence": 0.5}}' if "JSON" in prompt else f"  {body.upper()} "


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, upper(s_name) AS enhanced, s_name AS title, 0.5::DOUBLE AS confidence, s_name AS cell FROM supplier")
def model_stand_in(spark, sf_dir):
    """Text enhanced and pages structured by a client."""
    from ..providers import llm

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("text"))
    better = llm.enhance(rows, Proofreader(), into="enhanced").select("key", "enhanced")
    pages = llm.structure(rows, Proofreader(), ["key"])
    return better.join(pages, "key").select("key", "enhanced", "page.title", "page.confidence", F.col("page.tables")[0][1][0].alias("cell"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name || '!' AS text, upper(n_name) AS shouted FROM nation")
def registered_formats(spark, sf_dir):
    """A parser and a renderer of one's own."""
    sources.register_parser("shout", _parse_shout)
    sinks.register_renderer("shout", _render_shout)
    try:
        docs = parsed(table(spark, sf_dir, "nation"), "n_nationkey", F.col("n_name"), "shout")
        made = sinks.render(docs, "shout").select(key_of().alias("key"), F.decode("content", "UTF-8").alias("shouted"))
        return docs.select(key_of().alias("key"), F.col("sections")[0]["elements"][0]["text"].alias("text")).join(made, "key")
    finally:
        sources.PARSERS.pop("shout")
        sinks.BINARY.pop("shout")


def _parse_shout(data: bytes, name: str = "", **_) -> dict:
    return model.document("shout", data.decode(), [model.section("s", [model.paragraph(data.decode() + "!")])])


def _render_shout(doc: dict) -> bytes:
    return doc["title"].upper().encode()


@query("SELECT * FROM (VALUES ('html', 'Blank', 0::INTEGER), ('pdf', 'Blank', 0::INTEGER)) AS t(format, title, n_sections)")
def blank_documents(spark, sf_dir):
    return model.blank(spark, "html", "Blank").unionByName(model.blank(spark, "pdf", "Blank")).select("format", "title", F.size("sections").alias("n_sections"))
