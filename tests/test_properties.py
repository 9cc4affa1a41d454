"""Properties over generated inputs."""

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum import model as m
from vellum import sinks
from vellum.operators import layout
from vellum.sinks import binary
from vellum.sources import ole, parse, pdf
from vellum.sources.legacy import number_text

LINE = st.text(st.characters(exclude_categories=("Cs", "Cc", "Zl", "Zp")), max_size=30)
GRID = st.lists(st.lists(LINE, min_size=2, max_size=4), min_size=1, max_size=6)


def rows_of(doc):
    return [[c["text"] for c in r["cells"]] for r in doc["sections"][0]["elements"][0]["table"]["rows"]]


def sheet(grid):
    return m.document("csv", "t", [m.section("data", [m.table([(i == 0, r) for i, r in enumerate(grid)])])])


@settings(max_examples=60, deadline=None)
@given(GRID)
def test_shared_strings_round_trip(grid):
    grid = [[f"x{c}" for c in r] for r in grid]  # texts, never numbers
    for fmt, width in (("xlsx", None), ("xls", max(map(len, grid)))):
        got, widest = rows_of(parse(f"a.{fmt}", getattr(binary, f"render_{fmt}")(sheet(grid)))), 0
        for want, row in zip(grid, got, strict=True):
            widest = max(widest, len(want))
            clean = [binary.NOT_XML.sub("", c) if fmt == "xlsx" else c for c in want]
            assert row == clean + [""] * ((width or widest) - len(want))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text(st.characters(min_codepoint=65, max_codepoint=90), min_size=1, max_size=20), st.binary(max_size=20_000), max_size=6))
def test_containers_keep_streams(streams):
    back = ole.OleFile(ole.write_ole(streams))
    for name, data in streams.items():
        assert back.stream(name)[: len(data)] == data and not back.stream(name)[len(data) :].strip(b"\0")


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=200), st.floats(20, 400))
def test_wrapping_keeps_words_in_order(text, width):
    lines = binary.wrap(text, "Helvetica", 12.0, width)
    assert " ".join(lines).split() == text.split()
    assert all(binary.text_width(x, "Helvetica", 12.0) <= width or " " not in x.strip() for x in lines)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(min_codepoint=33, max_codepoint=255, exclude_categories=("Cc",)), min_size=1, max_size=40))
def test_pdf_strings_round_trip(text):
    text = text.encode("cp1252", "ignore").decode("cp1252").strip() or "x"
    raw = text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    got = [v for k, v in pdf.tokens(b"(" + raw + b") Tj") if k == "text"]
    assert got == [text.encode("cp1252")]


@given(st.floats(-1e14, 1e14))
def test_numbers_read_back(x):
    assert abs(float(number_text(x)) - x) <= 1e-10 + abs(x) * 1e-15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.just("t"), st.floats(0, 600).map(lambda v: round(v, 1)), st.floats(0, 100).map(lambda v: round(v, 1))), max_size=30))
def test_layout_loses_no_segment(segments):
    lines = layout.group_lines(layout.reading_order(segments))
    assert sorted(s for line in lines for s in line) == sorted(segments)
    for line in lines:
        assert sorted(s for c in layout.clusters(line) for s in c) == sorted(line)
        assert all(abs(s[2] - line[0][2]) < layout.LINE_GAP for s in line)


def test_csv_fields_round_trip(spark):
    cells = ["", "a", "a b", 'q"q', "x,y", "l\nm", "\t", '""', "é;ü", " lead", "end ", "'", "a\\b"]
    grid = [[a, b, a + b] for a in cells for b in cells]
    out = sinks.render(m.documents(spark, [sheet(grid)]), "csv", bom=False).first().content.decode()
    assert list(csv.reader(io.StringIO(out, newline=""))) == grid
    assert rows_of(parse("a.csv", out.encode())) == grid


def test_tables_survive_text_formats(spark):
    cells = ["a", "x|y", "<b>&", "'q'", '"d"', "é 漢", "1.50"]
    grid = [[a, b] for a in cells for b in cells]
    df = m.documents(spark, [sheet(grid)])
    for fmt in ("md", "html"):
        made = sinks.render(df, fmt).withColumn("doc_id", F.lit(f"t.{fmt}"))
        assert rows_of(parse(f"t.{fmt}", made.first().content)) == grid
