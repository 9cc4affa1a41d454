"""Work that parsers do not do: what is looked at for each line, tag and object costs most on many small files."""

import gc

import pytest

from vellum import model, sources
from vellum.sources import markup


class Never:
    def __getattr__(self, name):
        raise AssertionError(name)


def test_collector_rests_while_documents_are_made(spark):
    sources.register_parser("seen", lambda data, name="", **_: model.document("seen", str(__import__("gc").get_threshold()[0])))
    try:
        files = spark.createDataFrame([("a.seen", b"x")], "path string, content binary")
        assert [r.title for r in sources.parse_files(files).collect()] == [str(sources.NEW_OBJECTS)]
    finally:
        sources.PARSERS.pop("seen")
    assert gc.get_threshold()[0] < sources.NEW_OBJECTS


def test_plain_tags_take_the_short_way(monkeypatch):
    page = b"<body><table><tr><td>1</td><TD>2</td></tr></table></body>"
    want = markup.parse_html(page, "a.html")
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.setattr(markup.HTMLParser, name, Never().__getattr__)
    assert markup.parse_html(page, "a.html") == want and [c["text"] for c in want["sections"][0]["elements"][0]["table"]["rows"][0]["cells"]] == ["1", "2"]
    with pytest.raises(AssertionError):
        markup.parse_html(b"<p id='x'>", "a.html")


def test_lines_are_only_asked_for_what_they_begin_with(monkeypatch):
    monkeypatch.setattr(markup, "HEAD", Never())
    monkeypatch.setattr(markup, "PICTURE", Never())
    assert [e["type"] for e in markup.markdown_blocks(["a line", "", "- item", "> said", "| a |"])] == ["paragraph", "paragraph", "paragraph", "table"]
    with pytest.raises(AssertionError):
        markup.markdown_blocks(["# head"])


def test_text_without_marks_is_one_run(monkeypatch):
    monkeypatch.setattr(markup, "INLINE_MARK", Never())
    assert markup.markdown_runs("plain text") == [model.run("plain text")] and markup.markdown_runs("") == []
    with pytest.raises(AssertionError):
        markup.markdown_runs("one *mark")
