"""Queries over files and tables: parsing, views, rendering, conversion, layout, and plain relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import functions as fn
from .. import model, sinks, sources
from ..operators import layout
from ..sinks import text as render
from .corpus import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, sf_dir) -> DataFrame:
    """The pages parsed, whole."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return sources.parse_files(files)


def page_id(c="doc_id"):
    return F.split_part(c, F.lit("."), F.lit(1)).cast("long")


ENTITIES = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, {ENTITIES.format('''regexp_extract(html, '<title>([^<]*)</title>', 1)''')} AS title FROM pages")
def html_titles(spark, sf_dir):
    return pages(spark, sf_dir).select(page_id().alias("page_id"), "title")


@query(f"SELECT page_id, {ENTITIES.format('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)''')} AS heading FROM pages WHERE html LIKE '%<h1>%'")
def html_first_headings(spark, sf_dir):
    heads = model.elements(pages(spark, sf_dir)).where("paragraph.style.heading_level = 1")
    return heads.groupBy("doc_id").agg(F.min_by("text", F.struct("section_ix", "element_ix")).alias("heading")).select(page_id().alias("page_id"), "heading")


#: DuckDB: the blocks of each page's body in order, as (page_id, k, block): list, box, heading, paragraphs (whose bold may be unclosed) and footer.
BLOCKS = r"""
cut AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<ul>.*?</ul>|<div class="ad">[^<]+|<h1>[^<]*|<p>(?:<b>)?[^<]+(?:<br>)?|<footer>[^<]+') AS l FROM pages),
blocks AS (SELECT page_id, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS k FROM cut),
texts AS (SELECT page_id, k, block, {0} AS raw FROM (SELECT page_id, k, block, regexp_replace(replace(block, '<br>', chr(10)), '<[^>]*>', '', 'g') AS t FROM blocks)),
elements AS (SELECT page_id, CAST(0 AS INTEGER) AS section_ix, CAST(k AS INTEGER) AS element_ix, 'paragraph' AS type, block, CASE WHEN block LIKE '<ul>%' OR block LIKE '<footer>%' THEN trim(raw) ELSE raw END AS text FROM texts)
""".replace("{0}", f"replace(replace({ENTITIES.replace('{0}', 't').replace(", '&amp;', '&')", ", '&copy;', '©')")}, '&middot;', '·'), '&amp;', '&')")


@query(f"WITH {BLOCKS} SELECT page_id, section_ix, 'main' AS name, CAST(count(*) AS INTEGER) AS n_elements FROM elements GROUP BY page_id, section_ix")
def html_sections(spark, sf_dir):
    return model.sections(pages(spark, sf_dir)).select(page_id().alias("page_id"), "section_ix", "name", F.size("elements").alias("n_elements"))


@query(f"WITH {BLOCKS} SELECT page_id, section_ix, element_ix, type, text FROM elements")
def html_elements(spark, sf_dir):
    return model.elements(pages(spark, sf_dir)).select(page_id().alias("page_id"), "section_ix", "element_ix", "type", "text")


@query(f"""WITH {BLOCKS}
SELECT page_id, section_ix, element_ix, CAST(0 AS INTEGER) AS run_ix, rtrim(text, chr(10)) AS text, CASE WHEN block LIKE '<h1>%' OR block LIKE '<p><b>%' THEN true END AS bold FROM elements
UNION ALL SELECT page_id, section_ix, element_ix, 1, chr(10), NULL FROM elements WHERE block LIKE '%<br>'""")
def html_runs(spark, sf_dir):
    return model.runs(pages(spark, sf_dir)).select(page_id().alias("page_id"), "section_ix", "element_ix", "run_ix", "text", F.col("style.bold").alias("bold"))


@query(f"WITH {BLOCKS} SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM elements GROUP BY type")
def element_type_counts(spark, sf_dir):
    return model.elements(pages(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {BLOCKS}
SELECT page_id, string_agg(CASE WHEN block LIKE '<h1>%' THEN '# ' || text WHEN block LIKE '<p><b>%' THEN '**' || rtrim(text, chr(10)) || '**' || CASE WHEN block LIKE '%<br>' THEN chr(10) ELSE '' END ELSE text END || chr(10) || chr(10), '' ORDER BY element_ix) AS markdown
FROM elements GROUP BY page_id""")
def html_to_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select(page_id().alias("page_id"), render.render_markdown().alias("markdown"))


#: DuckDB: a text in HTML, and a run with the style of bold text of a size.
ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
BOLD = "'<span style=\"font-family:Helvetica,sans-serif;font-size:{0}pt;color:#000000;font-weight:bold\">' || " + ESCAPED.format("rtrim(text, chr(10))") + " || '</span>'"


@query(f"""WITH {BLOCKS},
made AS (SELECT page_id, string_agg(CASE WHEN block LIKE '<h1>%' THEN '<h1 style="text-align:left;margin-bottom:6pt;line-height:1.15">' || {BOLD.format(24)} || '</h1>'
  ELSE '<p>' || CASE WHEN block LIKE '<p><b>%' THEN {BOLD.format(12)} || CASE WHEN block LIKE '%<br>' THEN chr(10) ELSE '' END ELSE {ESCAPED.format('text')} END || '</p>' END || chr(10), '' ORDER BY element_ix) AS body FROM elements GROUP BY page_id)
SELECT page_id, '<!DOCTYPE html>' || chr(10) || '<html lang="fr">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<meta name="viewport" content="width=device-width, initial-scale=1.0">' || chr(10)
  || '<title>' || {ESCAPED.format(ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} || '</title>' || chr(10) || '<style>{render.STYLE_SHEET}</style>' || chr(10) || '</head>' || chr(10)
  || '<body style="font-family:Helvetica,sans-serif;font-size:12pt;color:#000000;max-width:800px;margin:0 auto;padding:40px 20px;">' || chr(10) || '<section id="main">' || chr(10) || body || '</section>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html
FROM pages JOIN made USING (page_id)""")
def html_to_html(spark, sf_dir):
    return pages(spark, sf_dir).select(page_id().alias("page_id"), render.render_html().alias("html"))


#: DuckDB: a run of bold text of a size in the JSON form, and one without a style.
JSON_BOLD = """'{"text":' || to_json(rtrim(text, chr(10)))::VARCHAR || ',"style":{"fontFamily":"Helvetica","fontSize":SIZE,"color":"#000000","bold":true,"italic":false,"underline":false}}'"""
JSON_PLAIN = """'{"text":' || to_json(X)::VARCHAR || ',"style":null}'"""


@query(f"""WITH {BLOCKS},
made AS (SELECT page_id, string_agg('{{"type":"paragraph","text":' || to_json(text)::VARCHAR || ',"runs":[' || CASE WHEN block LIKE '<h1>%' THEN {JSON_BOLD.replace('SIZE', '24.0')}
  WHEN block LIKE '<p><b>%' THEN {JSON_BOLD.replace('SIZE', '12.0')} || CASE WHEN block LIKE '%<br>' THEN ',' || {JSON_PLAIN.replace('X', 'chr(10)')} ELSE '' END ELSE {JSON_PLAIN.replace('X', 'text')} END
  || '],"style":' || CASE WHEN block LIKE '<h1>%' THEN '{{"alignment":"left","spaceBefore":0.0,"spaceAfter":6.0,"lineSpacing":1.15,"headingLevel":1}}' ELSE 'null' END || '}}', ',' ORDER BY element_ix) AS body FROM elements GROUP BY page_id)
SELECT page_id, '{{"format":"html","title":' || to_json({ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")})::VARCHAR || ',"metadata":{{}},"sections":[{{"name":"main","elements":[' || body || ']}}]}}' AS json FROM pages JOIN made USING (page_id)""")
def documents_json(spark, sf_dir):
    return model.to_json(pages(spark, sf_dir)).select(page_id().alias("page_id"), "json")


@query("SELECT page_id, page_id % 25 > 0 AND (page_id // 25 % 4) / greatest(page_id % 25 + page_id // 25 % 4, 1)::DOUBLE < 0.1 AS needs_ocr FROM pages")
def needs_ocr(spark, sf_dir):
    """Scans of up to 24 pictures with up to three paragraphs between them, made as HTML from the pages' numbers and parsed."""
    n = F.col("page_id")
    html = F.concat(F.lit("<body>"), F.repeat(F.lit('<img src="scan.png" width="600" height="800">'), (n % 25).cast("int")), F.repeat(F.lit("<p>Legende</p>"), (F.floor(n / 25) % 4).cast("int")), F.lit("</body>"))
    files = table(spark, sf_dir, "pages").select(F.concat(n.cast("string"), F.lit(".html")).alias("path"), F.encode(html, "UTF-8").alias("content"))
    return sources.parse_files(files).select(page_id().alias("page_id"), F.exists("sections", lambda s: model.needs_ocr(s["elements"])).alias("needs_ocr"))


# Tables as documents


def nation(spark, sf_dir) -> DataFrame:
    return model.table_of(table(spark, sf_dir, "nation"), "n_nationkey", "nation", columns=["n_nationkey", "n_name", "n_regionkey"])


FIELD = "CASE WHEN regexp_matches({0}, '[,\"\\s]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"""SELECT 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || {FIELD.format('n_name')} || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation""")
def csv_render(spark, sf_dir):
    return nation(spark, sf_dir).select(render.render_csv(bom=False).alias("csv"))


@query("""SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) AS markdown FROM nation""")
def markdown_table_render(spark, sf_dir):
    return nation(spark, sf_dir).select(render.render_markdown().alias("markdown"))


@query("""SELECT '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>n_nationkey</th><th>n_name</th><th>n_regionkey</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
  || string_agg('<tr><td>' || n_nationkey || '</td><td>' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || n_regionkey || '</td></tr>', chr(10) ORDER BY n_nationkey)
  || chr(10) || '</tbody>' || chr(10) || '</table>' AS html FROM nation""")
def html_table_render(spark, sf_dir):
    return nation(spark, sf_dir).select(F.regexp_extract(render.render_html(), r"(?s)<table>.*</table>", 0).alias("html"))


CUSTOMER = ("c_custkey", "c_name", "c_mktsegment")
#: Customers whose keys lie in one range are a document.
KEYS = 1000
CELLS = f"""WITH c AS (SELECT c_custkey // {KEYS} AS part, CAST(row_number() OVER (PARTITION BY c_custkey // {KEYS} ORDER BY c_custkey) AS INTEGER) AS row_ix, CAST(c_custkey AS VARCHAR) AS k, c_name, c_mktsegment FROM customer)
SELECT part, row_ix, col_ix, text FROM (
  SELECT part, CAST(0 AS INTEGER) AS row_ix, unnest([0, 1, 2])::INTEGER AS col_ix, unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS text FROM (SELECT DISTINCT part FROM c)
  UNION ALL SELECT part, row_ix, 0, k FROM c UNION ALL SELECT part, row_ix, 1, c_name FROM c UNION ALL SELECT part, row_ix, 2, c_mktsegment FROM c)"""


def customers(spark, sf_dir) -> DataFrame:
    """A document for each range of keys, so that a table of any size is many documents and no task gathers it all."""
    return model.table_of(table(spark, sf_dir, "customer"), "c_custkey", "customer", columns=list(CUSTOMER), by=F.floor(F.col("c_custkey") / KEYS))


def cells(df: DataFrame) -> DataFrame:
    return model.cells(df).select(F.regexp_extract("doc_id", "-([0-9]+)", 1).cast("long").alias("part"), "row_ix", "col_ix", "text")


@query(CELLS)
def table_to_cells(spark, sf_dir):
    return cells(customers(spark, sf_dir))


def _round_trip(fmt: str, sql: str | None, **options):
    def run(spark, sf_dir):
        made = sinks.render(customers(spark, sf_dir), fmt).withColumn("doc_id", F.concat("doc_id", F.lit(f".{fmt}")))
        return cells(sources.parse_files(made, "doc_id", "content", **options))

    run.__name__ = f"convert_roundtrip_{fmt}"
    query(sql)(run)


_round_trip("csv", CELLS)
_round_trip("md", CELLS)
_round_trip("html", CELLS)
_round_trip("xlsx", CELLS)
_round_trip("xls", CELLS)
_round_trip("pptx", CELLS)
_round_trip("docx", CELLS)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS element_ix, n_nationkey || chr(9) || n_name AS text FROM nation")
def convert_roundtrip_doc(spark, sf_dir):
    doc = model.table_of(table(spark, sf_dir, "nation"), "n_nationkey", "nation", columns=["n_nationkey", "n_name"])
    made = sinks.render(doc, "doc").withColumn("doc_id", F.lit("nation.doc"))
    return model.elements(sources.parse_files(made, "doc_id", "content")).where("element_ix > 0").select((F.col("element_ix") - 1).alias("element_ix"), "text")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS element_ix, n_nationkey || ' | ' || n_name AS text FROM nation")
def convert_roundtrip_ppt(spark, sf_dir):
    doc = model.table_of(table(spark, sf_dir, "nation"), "n_nationkey", "nation", columns=["n_nationkey", "n_name"])
    made = sinks.render(doc, "ppt").withColumn("doc_id", F.lit("nation.ppt"))
    return model.elements(sources.parse_files(made, "doc_id", "content")).where("element_ix > 0").select((F.col("element_ix") - 1).alias("element_ix"), "text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def convert_roundtrip_pdf(spark, sf_dir):
    made = sinks.render(nation(spark, sf_dir), "pdf").withColumn("doc_id", F.lit("nation.pdf"))
    rows = model.table_rows(sources.parse_files(made, "doc_id", "content")).where("NOT is_header OR section_ix > 0")
    return rows.select(*[F.col("cells")[k]["text"].alias(n) for k, n in enumerate(("key", "name", "region"))])


@query()
def pdf_positions(spark, sf_dir):
    made = sinks.render(nation(spark, sf_dir), "pdf").withColumn("doc_id", F.lit("nation.pdf"))
    return sources.pdf_segments(made, "doc_id", "content")


# Layout


@query("""
WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x FROM embeddings),
s AS (SELECT label, vec_id, coalesce(CAST(x - lag(x) OVER (PARTITION BY label ORDER BY x, vec_id) > 40 AS INTEGER), 0) AS new, x FROM p)
SELECT label, vec_id, CAST(sum(new) OVER (PARTITION BY label ORDER BY x, vec_id) AS INTEGER) AS cluster_ix FROM s""")
def x_clusters(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0].cast("double") * 1000).alias("x"))
    return layout.x_clusters(points, ["label"], order="vec_id").select("label", "vec_id", "cluster_ix")


@query("""WITH RECURSIVE p AS (SELECT label, vec_id, CAST(embedding[2] AS DOUBLE) * 10 AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
g AS (SELECT label, vec_id, k, y AS anchor, CAST(0 AS INTEGER) AS line_ix FROM p WHERE k = 1
  UNION ALL SELECT p.label, p.vec_id, p.k, CASE WHEN abs(p.y - g.anchor) >= {gap} THEN p.y ELSE g.anchor END, g.line_ix + CAST(abs(p.y - g.anchor) >= {gap} AS INTEGER) FROM g JOIN p ON p.label = g.label AND p.k = g.k + 1)
SELECT label, vec_id AS seg_ix, line_ix FROM g""".replace("{gap}", str(layout.LINE_GAP)))
def y_groups(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("seg_ix"), (F.col("embedding")[1].cast("double") * 10).alias("y"))
    return layout.line_groups(points, ["label"]).select("label", "seg_ix", "line_ix")


@query("SELECT vec_id, CAST(list_position([abs(x + 100), abs(x), abs(x - 100)], list_min([abs(x + 100), abs(x), abs(x - 100)])) - 1 AS INTEGER) AS \"column\" FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x FROM embeddings)")
def nearest_columns(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 1000).alias("x"))
    return layout.nearest_column(points, [-100.0, 0.0, 100.0]).select("vec_id", "column")


# Scalars


#: DuckDB: the letter of each place, for numbers n from the first that has so many letters.
PLACES = " || ".join(f"CASE WHEN n >= {sum(26**j for j in range(k + 1))} THEN chr(CAST(65 + ((n - {sum(26**j for j in range(k + 1))}) // {26**k}) % 26 AS INTEGER)) ELSE '' END" for k in range(5, -1, -1))


@query(f"SELECT c_custkey, {PLACES} AS letters, c_custkey - 1 AS back FROM (SELECT c_custkey, CAST(c_custkey AS BIGINT) AS n FROM customer WHERE c_custkey >= 1)")
def column_letters(spark, sf_dir):
    """Letters of every customer key from 1, the first column, and back."""
    keys = table(spark, sf_dir, "customer").where("c_custkey >= 1").select("c_custkey", fn.column_letters(F.col("c_custkey") - 1).alias("letters"))
    return keys.withColumn("back", fn.column_index(F.concat("letters", F.lit("7"))))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN printf('%.0f', o_totalprice) ELSE regexp_replace(regexp_replace(printf('%.10f', o_totalprice), '0+$', ''), '\\.$', '') END AS price,
  CASE WHEN o_orderkey >= 1048576 THEN regexp_replace(CAST(round(o_orderkey / 1048576.0, 1) AS VARCHAR), '\\.0$', '') || ' Mo'
       WHEN o_orderkey >= 1024 THEN regexp_replace(CAST(CAST(round(o_orderkey / 1024.0, 1) AS DOUBLE) AS VARCHAR), '\\.0$', '') || ' Ko' ELSE o_orderkey || ' o' END AS size
FROM orders""")
def number_formats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fn.format_number(F.col("o_totalprice")).alias("price"), fn.human_size(F.col("o_orderkey")).alias("size"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{e}', '{model.MIME_TYPES[f]}', {str(f in model.OFFICE).lower()}, {str(f in model.TEXT_BASED).lower()})" for f, es in model.EXTENSIONS.items() for e in es) + ") AS t(format, extension, mime_type, is_office, is_text)")
def format_registry(spark, sf_dir):
    return model.formats(spark)


@query("SELECT page_id, CAST(greatest(1, round(w * least(300.0 / w, 300.0 / h, 1.0))) AS INTEGER) AS width, CAST(greatest(1, round(h * least(300.0 / w, 300.0 / h, 1.0))) AS INTEGER) AS height FROM (SELECT page_id, CAST(length(html) AS DOUBLE) AS w, CAST(length(url) AS DOUBLE) * 10 AS h FROM pages)")
def thumbnail_sizes(spark, sf_dir):
    from ..providers.thumbnails import fit_columns

    size = fit_columns(F.length("html").cast("double"), F.length("url").cast("double") * 10)
    return table(spark, sf_dir, "pages").select("page_id", size.alias("s")).select("page_id", "s.width", "s.height")


# Providers, with stand-ins


@query("SELECT page_id, 'Texte reconnu sur la page numéro ' || page_id || ' lisible' AS text FROM pages")
def ocr_stand_in(spark, sf_dir):
    """Scanned pages (one image each) read by a stand-in engine that returns the bytes it is given."""
    from ..providers.ocr import FunctionOcr, ocr

    scans = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.encode(F.concat(F.lit("Texte reconnu sur la page numéro "), F.col("page_id").cast("string"), F.lit(" lisible")), "UTF-8").alias("data"))
    image = F.struct(F.lit("").alias("src"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("").alias("alt"), F.lit("image/png").alias("mime_type"), F.col("data"))
    element = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(model.PARAGRAPH).alias("paragraph"), F.lit(None).cast(model.TABLE).alias("table"), image.alias("image"))
    section = F.struct(F.lit("page-1").alias("name"), F.create_map().cast("map<string,string>").alias("metadata"), F.array(element).alias("elements"))
    style = F.struct(*[F.lit(v).alias(k) for k, v in model.text_style().items()])
    docs = scans.select("doc_id", F.lit("").alias("source_file"), F.lit("pdf").alias("format"), F.lit("").alias("title"), F.create_map().cast("map<string,string>").alias("metadata"), style.alias("default_style"), F.array(section).alias("sections"), F.lit(None).cast("string").alias("error"))
    read = ocr(docs, FunctionOcr(lambda data, _: data.decode()), "auto", "fra")
    return read.select(F.col("doc_id").cast("long").alias("page_id"), model.plain_text().alias("text"))


# Plain relations: the DataFrame and SQL surface over the tables


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT n_name, c_mktsegment, grouping(n_name) + grouping(c_mktsegment) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY ROLLUP (n_name, c_mktsegment)""")
def customers_rollup(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_name", "c_mktsegment")
    return out.agg((F.grouping("n_name") + F.grouping("c_mktsegment")).cast("long").alias("level"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders(spark, sf_dir):
    spot = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(spot)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def idle_customers(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey").intersect(c.where("c_acctbal > 0").select("c_custkey"))
