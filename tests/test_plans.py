"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry

#: Rendering of text formats and all text operators stay in the JVM.
NATIVE = [
    "top_words_by_language", "dictionary_build", "dictionary_append", "ngram_bigrams", "bigram_score", "detect_language", "garbage_filter", "natural_word_stats", "noise_lines", "clean_noise", "confusion_fix",
    "cid_collapse", "entities_all", "line_classes", "structure_markdown", "structure_blocks", "paragraphs_split", "spell_candidates", "spell_correct", "ngram_correct", "pipeline_layers", "slide_grouping",
    "csv_render", "markdown_table_render", "html_table_render", "x_clusters", "nearest_columns", "number_formats",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n not in ("pipeline", "stream_dictionary")])
def test_no_pairwise_join(spark, sf, name):
    found = plan(entry.queries()[name](spark, sf))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", found), found
    if name in NATIVE:
        assert not re.search("Python|Pandas|Arrow", found), found


@pytest.mark.parametrize(("name", "wanted"), [("dictionary_build", "text"), ("detect_language", "doc_id,text"), ("text_by_quality", "doc_id,lang,n_chars")])
def test_only_needed_columns_are_read(spark, sf, name, wanted):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()[name](spark, sf)))
    assert sorted(x.split(":")[0] for x in found[0].split(",")) == wanted.split(",")


def test_filters_reach_the_scan(spark, sf):
    found = plan(entry.queries()["pricing_summary"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in found


def test_counts_are_partial_before_the_shuffle(spark, sf):
    found = plan(entry.queries()["dictionary_build"](spark, sf))
    assert found.index("Exchange") < found.index("partial_count")


def test_rendering_does_not_shuffle(spark, sf):
    for name in ("html_to_markdown", "html_to_html", "documents_json", "html_elements", "clean_noise", "entities_all"):
        assert "Exchange" not in plan(entry.queries()[name](spark, sf)), name


def test_shared_folder():
    """The cluster's folder if it names one; else only a local master has one."""
    from vellum import scratch

    def session(folder, master):
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)})
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master, "applicationId": "app"})})

    assert scratch.shared_dir(session("hdfs://shared", "yarn")) == "hdfs://shared"
    assert scratch.shared_dir(session(None, "local[4]")) == "file:///tmp/checkpoints/app" == scratch.shared_dir(session(None, "local"))
    with pytest.raises(ValueError):
        scratch.shared_dir(session(None, "local-cluster[3,2,1024]"))
