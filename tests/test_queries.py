"""Every query with SQL against DuckDB on the same files; the others run and give stable schemas."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    return "NULL" if v is None else float(f"{v:.9g}") if isinstance(v, float) else str(v) if isinstance(v, (list, dict)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        found = [x[0] for x in cur.description]
        assert sorted(found) == columns
        at = [found.index(c) for c in columns]
        assert rows == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_column_letters_of_all_keys(spark, tmp_path):
    keys = [1, 26, 27, 702, 703, 18278, 18279, 150_000, 475_254, 475_255, 15_000_000, 2**31 - 1]
    spark.createDataFrame([(k,) for k in keys], "c_custkey int").write.parquet(f"{tmp_path}/customer.parquet")

    def letters(n):
        return letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""

    got = {(r.c_custkey, r.letters, r.back) for r in entry.queries()["column_letters"](spark, str(tmp_path)).collect()}
    assert got == {(k, letters(k), k - 1) for k in keys}


#: Pages whose titles and headings are cut within a reference, as those of the tables are, and one with such texts elsewhere.
CUT = [
    f"<!DOCTYPE html><html><head><title>{t}</title><script>a && b &amp</script></head><body><nav><ul><li><a href=\"/x\">x</a></li></ul></nav><div class=\"ad\">ad</div><article><h1>{t}</h1><p><b>{t}<br><p>{p}</p></article><footer>&copy; {t}</footer></body></html>"
    for t, p in (("one&amp; two&amp", "three"), ("&lt;one&l", "a &lt b &ampere; c"), ("one &am", "a &amp;lt; & &copy d"), ("one &quot", "R&D &quot;two&quot; &gt"), ("plain", "&middot;"))
]


@pytest.mark.parametrize("name", ["documents_json", "element_type_counts", "html_elements", "html_first_headings", "html_runs", "html_titles", "html_to_html", "html_to_markdown"])
def test_references_cut_off(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(CUT)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(norm(x) for x in r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", ["css_styles", "front_matter", "html_spans", "markdown_blocks", "markdown_marks"])
def test_documents_of_a_small_file_are_parsed_by_all_cores(spark, sf, name):
    assert entry.queries()[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
