"""Sources, sinks, model and layout: inline fixtures and round trips."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum import model as m
from vellum import sinks, sources
from vellum.operators import layout
from vellum.plans import manager
from vellum.sinks import binary
from vellum.sources import markup, ole, parse, pdf


def texts(doc):
    return [(e["type"], e["text"]) for s in doc["sections"] for e in s["elements"]]


def rows(doc, k=0):
    tables = [e["table"] for s in doc["sections"] for e in s["elements"] if e["type"] == "table"]
    return [[c["text"] for c in r["cells"]] for r in tables[k]["rows"]]


def report():
    return m.document(
        "md",
        "Rapport <2026>",
        [
            m.section("introduction", [
                m.heading("Introduction", 1),
                m.paragraph([m.run("Ventes "), m.run("d'hiver", m.text_style(bold=True, color="#1A5276")), m.run(" en hausse")], m.para_style(alignment="justify")),
                m.table([(True, ["Poste", "Montant", "Écart"]), (False, ["CA", "73400", "+9%"]), (False, ["a|b", "12,5", 'q "x"']), (False, ["N", "3", "z"])]),
            ]),
            m.section("conclusion", [m.heading("Conclusion", 2), m.page_break(), m.image("/logo.png", 200, 100, "Logo"), m.paragraph("Fin.")]),
        ],
        {"author": "Moi"},
        doc_id="report.md",
    )


# CSV


@pytest.mark.parametrize(
    ("name", "data", "options", "want", "header"),
    [
        ("rivers.csv", "Fleuve,km\nRhône,812\nLoire,1006", {}, [["Fleuve", "km"], ["Rhône", "812"], ["Loire", "1006"]], True),
        ("x.csv", "A,B\n1,2", {"header": False}, [["A", "B"], ["1", "2"]], False),
        ("bom.csv", "﻿Name,Value\nx,1", {}, [["Name", "Value"], ["x", "1"]], True),
        ("q.csv", 'Name,Description\n"Alice, Bob","dit ""oui"""', {}, [["Name", "Description"], ["Alice, Bob", 'dit "oui"']], True),
        ("s.csv", "A;B;C\n1;2;3", {"delimiter": ";"}, [["A", "B", "C"], ["1", "2", "3"]], True),
        ("t.tsv", "port\tdepth\nBrest\t11.5\nSète\t14", {}, [["port", "depth"], ["Brest", "11.5"], ["Sète", "14"]], True),
        ("ragged.csv", "a,b\n\nc,d,e\n", {}, [["a", "b"], [""], ["c", "d", "e"]], True),
        ("empty.csv", "", {}, [], None),
    ],
)
def test_csv(name, data, options, want, header):
    doc = parse(name, data.encode(), **options)
    assert rows(doc) == want and doc["title"] == name.split(".")[0] and doc["sections"][0]["name"] == "data"
    if want:
        assert doc["sections"][0]["elements"][0]["table"]["rows"][0]["is_header"] is header


def test_csv_limit():
    data = "\n".join(str(i) for i in range(10_500)).encode()
    whole, cut = parse("a.csv", data), parse("a.csv", data, limit=markup.ROW_LIMIT)
    assert len(rows(whole)) == 10_500 and "rows_left_out" not in whole["metadata"]
    assert len(rows(cut)) == 10_000 and cut["metadata"]["rows_left_out"] == "500"


# HTML


def test_html():
    page = """<html><head><title>Titre &amp; suite</title></head><body><h1>Un</h1><p style="text-align:center;margin-top:4px;line-height:1.5">Texte <strong>gras</strong> et <em>fin <b>tous</b></em><br>fini
    <p>Sans fin <b>ouvert<ul><li>a<li>b</ul>nu<table style="border-color:#f00;border-width:2px;border-style:dashed"><thead><tr><th colspan=3>H</th></tr></thead><tbody><tr><td>1<td>2<td>3</table>
    <span>s</span><img src="/logo.png" width="200" height="100" alt="Logo"><figure><img src="/photo.jpg"></figure><hr><div><h6>Six</h6></div></body></html>"""
    doc = parse("p.html", page.encode())
    assert doc["title"] == "Titre & suite" and [s["name"] for s in doc["sections"]] == ["main"]
    e = doc["sections"][0]["elements"]
    assert e[0]["paragraph"]["style"]["heading_level"] == 1 and e[0]["paragraph"]["runs"][0]["style"]["font_size"] == 24.0
    assert [(r["text"], bool(r["style"] and r["style"]["bold"]), bool(r["style"] and r["style"]["italic"])) for r in e[1]["paragraph"]["runs"]][:4] == [("Texte ", False, False), ("gras", True, False), (" et ", False, False), ("fin ", False, True)]
    assert e[1]["paragraph"]["style"]["alignment"] == "center" and e[1]["paragraph"]["style"]["space_before"] == 3.0 and e[1]["paragraph"]["style"]["line_spacing"] == 1.5
    images = [x["image"] for x in e if x["type"] == "image"]
    assert [(i["src"], i["width"], i["height"], i["alt"]) for i in images] == [("/logo.png", 200, 100, "Logo"), ("/photo.jpg", 0, 0, "")]
    table = next(x["table"] for x in e if x["type"] == "table")
    assert [[(c["text"], c["colspan"]) for c in r["cells"]] for r in table["rows"]] == [[("H", 3)], [("1", 1), ("2", 1), ("3", 1)]]
    assert table["rows"][0]["is_header"] and table["style"]["border_width"] == 1.5 and table["style"]["border_style"] == "dashed"
    assert ("page_break", None) in texts(doc) and ("paragraph", "Six") in texts(doc)


def test_html_sections_and_styles():
    doc = parse("p.html", b'<body>out<section id="intro"><p>a</p></section><section id="body"><p><span style="font-weight:bold;color:#FF0000;font-size:18pt">x</span></p></section></body>')
    assert [s["name"] for s in doc["sections"]] == ["intro", "body"]
    style = doc["sections"][1]["elements"][0]["paragraph"]["runs"][0]["style"]
    assert style["bold"] and style["color"] == "#FF0000" and style["font_size"] == 18.0
    with_script = b"<body><script>x()</script><p>a</p></body>"
    assert len(texts(parse("p.html", with_script))) == 2 and len(texts(parse("p.html", with_script, scripts=False))) == 1


# Markdown


def test_markdown():
    text = """---
title: "Mon titre"
auteur: Moi
date: 2026-01-01
---
# Un **gras**
Deux
====
Trois
-----
Un paragraphe
sur deux lignes avec **gras**, *fin*, ***tous***, `code` et [lien](http://x).

| a | b |
|---|:-:|
| 1 | x \\| y |

- un
- deux
1. trois

> dit
> elle

```php
x = 1

y = 2
```
![alt](img.png "t")
***
###### Six
"""
    doc = parse("x.md", text.encode())
    assert doc["title"] == "Mon titre" and doc["metadata"] == {"author": "Moi", "date": "2026-01-01"}
    got = texts(doc)
    assert [t for k, t in got if k == "paragraph"] == ["Un gras", "Deux", "Trois", "Un paragraphe sur deux lignes avec gras, fin, tous, code et lien.", "• un", "• deux", "1. trois", "« dit elle »", "x = 1\n\ny = 2", "Six"]
    assert rows(doc) == [["a", "b"], ["1", "x | y"]]
    runs = [(r["text"], r["style"]) for r in doc["sections"][0]["elements"][3]["paragraph"]["runs"]]
    assert [t for t, s in runs if s and s["bold"]] == ["gras", "tous"] and [t for t, s in runs if s and s["font_family"] == "Courier"] == ["code"]
    assert [k for k, _ in got][-3:] == ["image", "page_break", "paragraph"]
    assert doc["sections"][0]["elements"][-1]["paragraph"]["style"]["heading_level"] == 4


# Containers


def docx(body, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        for k, v in (extra or {}).items():
            z.writestr(k, v)
    return out.getvalue()


def test_docx():
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Titre</dc:title><dc:creator>Moi</dc:creator></cp:coreProperties>'
    styles = '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="S1"><w:name w:val="My Subtitle"/></w:style></w:styles>'
    body = (
        '<w:p><w:r><w:rPr><w:b/><w:i/><w:u w:val="single"/><w:color w:val="FF0000"/><w:sz w:val="28"/></w:rPr><w:t>Texte</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Titre deux</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="S1"/></w:pPr><w:r><w:t>Sous</w:t></w:r></w:p>'
        '<w:p><w:r><w:br w:type="page"/></w:r><w:r><w:t>apres</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    )
    doc = parse("d.docx", docx(body, {"docProps/core.xml": core, "word/styles.xml": styles}))
    assert doc["title"] == "Titre" and doc["metadata"] == {"author": "Moi"}
    e = doc["sections"][0]["elements"]
    assert e[0]["paragraph"]["runs"][0]["style"] == m.text_style(bold=True, italic=True, underline=True, color="#FF0000", font_size=14.0)
    assert [x["paragraph"]["style"]["heading_level"] for x in e[1:3]] == [2, 1]
    assert [k for k, _ in texts(doc)][3:] == ["page_break", "paragraph", "table"]
    cells = [c for r in e[-1]["table"]["rows"] for c in r["cells"]]
    assert [(c["text"], c["colspan"], c["rowspan"]) for c in cells] == [("a", 2, 1), ("b", 1, 2), ("", 1, 1)]
    with pytest.raises(ValueError):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").close()
        parse("d.docx", out.getvalue())


@pytest.mark.parametrize("fmt", ["xlsx", "xls", "pptx", "docx", "doc", "ppt", "pdf"])
def test_containers_round_trip(fmt):
    doc = parse(f"r.{fmt}", getattr(binary, f"render_{fmt}")(report()))
    said = "\n".join(t or "" for _, t in texts(doc)) + "\n".join("\n".join(r) for s in doc["sections"] for e in s["elements"] if e["type"] == "table" for r in [[c["text"] for c in x["cells"]] for x in e["table"]["rows"]])
    for word in ("Introduction", "hiver", "73400", "Conclusion", "Fin."):
        assert word in said, word
    assert doc["title"] == "Rapport <2026>" and doc["metadata"].get("author") == "Moi"


def test_many_strings_in_xls():
    big = m.document("csv", "big", [m.section("data", [m.table([(i == 0, [f"id{i}", "naïve – 漢字 " * 30, str(i + 0.5)]) for i in range(800)])]), m.section("a/b*c" + "x" * 40, [m.paragraph("p")])])
    got = parse("b.xls", binary.render_xls(big))
    assert rows(got)[-1] == ["id799", "naïve – 漢字 " * 30, "799.5"] and [s["name"] for s in got["sections"]] == ["data", ("a_b_c" + "x" * 40)[:31]]


def test_ole():
    streams = {"Alpha": b"a" * 10, "Beta": bytes(range(256)) * 300}
    back = ole.OleFile(ole.write_ole(streams))
    assert back.stream("alpha")[:10] == b"a" * 10 and back.stream("BETA") == streams["Beta"] and back.stream("none") is None
    with pytest.raises(ValueError):
        ole.OleFile(b"nothing")


def test_pdf_details():
    content = b"q 1 0 0 1 10 20 cm BT /F1 12 Tf 100 700 Td [(Bon) -250 (jour) 20 (!)] TJ 0 -20 Td (esc\\(ap\\351) Tj <4142> Tj ET Q BT /F1 9 Tf 1 0 0 1 50 50 Tm (bas de page) Tj ET"
    segments = pdf.text_segments(content, {"F1": {}})
    assert segments[0] == ("Bon jour!", 110.0, 720.0) and segments[1][0] == "esc(apé" and segments[1][2] == 700.0 and segments[2][0] == "AB" and segments[3] == ("bas de page", 50.0, 50.0)
    cmap = pdf.read_cmap(b"1 beginbfchar\n<01> <00E9>\nendbfchar 2 beginbfrange\n<02> <04> <0041>\n<05> <06> [<0058> <0059>]\nendbfrange")
    assert pdf.decode_codes(b"\x01\x02\x03\x04\x05\x06", cmap) == "éABCXY"
    for bad in (b"no pdf", b"%PDF-1.4\n<< /Encrypt 3 0 R >>"):
        with pytest.raises(ValueError):
            parse("x.pdf", bad)
    png = pdf.png_of(bytes(range(12)), 2, 2, 3)
    shown = m.document("md", "i", [m.section("s", [m.image("i.png", 2, 2, "", png, "image/png")])])
    doc = parse("x.pdf", binary.render_pdf(shown))
    assert texts(doc) == [("image", None)] and (doc["sections"][0]["elements"][0]["image"]["width"], doc["sections"][0]["elements"][0]["image"]["height"]) == (2, 2)


def test_unknown_formats(spark):
    with pytest.raises(ValueError):
        parse("x.odt", b"")
    with pytest.raises(ValueError):
        sinks.render(m.blank(spark, "md"), "odt")
    broken = spark.createDataFrame([("a.pdf", b"junk"), ("b.odt", b""), ("c.csv", b"x,y")], "path string, content binary")
    got = {r.doc_id: r.error for r in sources.parse_files(broken).collect()}
    assert "ValueError" in got["a.pdf"] and "no parser" in got["b.odt"] and got["c.csv"] is None


# Rendering


def test_text_renderers(spark):
    df = m.documents(spark, [report()])
    html = sinks.render(df, "html").first().content.decode()
    for part in ("<title>Rapport &lt;2026&gt;</title>", 'lang="fr"', '<section id="introduction">', "<thead>", "<th>Poste</th>", "d&#039;hiver</span>", "font-weight:bold", "text-align:justify", '<div class="page-break"></div>', '<figure><img src="/logo.png" alt="Logo" width="200" height="100"></figure>', "font-size:24pt"):
        assert part in html, part
    md = sinks.render(df, "md").first().content.decode()
    assert md.startswith("---\nauthor: Moi\n---\n\n# Introduction\n\nVentes **d'hiver** en hausse\n\n| Poste | Montant | Écart |\n| --- | --- | --- |\n") and "| a\\|b |" in md and "![Logo](/logo.png)" in md
    csv = sinks.render(df, "csv").first().content.decode("utf-8-sig")
    assert csv.split("\n")[:6] == ["Introduction", '"Ventes d\'hiver en hausse"', "Poste,Montant,Écart", "CA,73400,+9%", 'a|b,"12,5","q ""x"""', "N,3,z"]
    back = parse("x.md", md.encode())
    assert rows(back) == rows(report())
    again = parse("x.html", html.encode())
    assert rows(again) == rows(report()) and [s["name"] for s in again["sections"]] == ["introduction", "conclusion"]


def test_striped_rows(spark):
    t = m.table([(True, ["h"]), (False, ["1"]), (False, ["2"]), (False, ["3"])], m.table_style(striped_bg="#eee"))
    html = sinks.render(m.documents(spark, [m.document("md", "t", [m.section("s", [t])])]), "html").first().content.decode()
    assert html.count('style="background:#eee"') == 1 and '<tr style="background:#eee"><td>2</td>' in html


# Model


def test_views_and_columns(spark):
    df = m.documents(spark, [report(), m.document("csv", "e", doc_id="empty")])
    assert m.sections(df).count() == 2 and m.elements(df).count() == 7 and m.table_rows(df).count() == 4 and m.cells(df).count() == 12
    assert [r.text for r in m.runs(df).where("element_ix = 1 AND section_ix = 0").orderBy("run_ix").collect()] == ["Ventes ", "d'hiver", " en hausse"]
    m.register_views(df, "t_")
    assert spark.sql("SELECT count(*) FROM t_cells WHERE text = 'CA'").first()[0] == 1
    first = df.select(m.first_image().alias("i")).orderBy("doc_id").collect()
    assert [r.i and r.i.src for r in first] == [None, "/logo.png"]
    js = m.to_json(df).where("doc_id = 'report.md'").first().json
    assert '"format":"md"' in js and '"isHeader":true' in js and '"metadata":{"author":"Moi"}' in js and "defaultTextStyle" not in js
    assert m.remove_section(df, 0).where("doc_id = 'report.md'").select(F.size("sections")).first()[0] == 1


@pytest.mark.parametrize(("paragraphs", "images", "ratio", "want"), [(0, 0, 0.1, False), (2, 0, 0.1, False), (0, 1, 0.1, True), (9, 1, 0.1, False), (1, 1, 0.8, True)])
def test_needs_ocr(spark, paragraphs, images, ratio, want):
    df = m.documents(spark, [m.document("pdf", sections=[m.section("p", [m.paragraph("x")] * paragraphs + [m.image("i")] * images)])])
    assert df.select(m.needs_ocr(F.col("sections")[0]["elements"], ratio)).first()[0] is want


def test_formats(spark):
    df = spark.createDataFrame([("a/b.HTM",), ("x.mkd",), ("y.odt",), ("z.zip",), ("noext",)], "path string")
    assert [r[0] for r in df.select(m.format_of(m.extension_of(F.col("path")))).collect()] == ["html", "md", "odt", None, None]


# Layout


def test_layout():
    s = [("b", 100, 700), ("a", 20, 701.5), ("c", 20, 650), ("x", 20, 600), ("y", 120, 600), ("z", 220, 600), ("1", 22, 580), ("2", 121, 580), ("3", 219, 580), ("suite", 120, 570), ("fin", 20, 300)]
    got = layout.page_elements(s, lambda t: False, lambda t: t)
    assert [(e["type"], e["text"]) for e in got] == [("paragraph", "a b"), ("paragraph", "c"), ("table", None), ("paragraph", "fin")] or [e["type"] for e in got].count("table") == 1
    table = next(e for e in got if e["type"] == "table")["table"]["rows"]
    assert [[c["text"] for c in r["cells"]] for r in table][:2] == [["x", "y", "z"], ["1", "2 suite", "3"]]
    assert not layout.like_a_row([0, 100, 500]) and layout.take_table([[("a", 0, 10), ("b", 100, 10), ("c", 200, 10)]], 0) is None


def test_layout_frames(spark):
    rows_ = [(0, i, t, x, y) for i, (t, x, y) in enumerate([("a", 0.0, 10.0), ("b", 30.0, 11.5), ("c", 90.0, 12.5), ("d", 400.0, 8.0)])]
    df = spark.createDataFrame(rows_, "page int, seg_ix int, text string, x double, y double")
    assert [r.line_ix for r in layout.line_groups(df, ["page"]).orderBy("seg_ix").collect()] == [0, 0, 1, 2]
    c = layout.x_clusters(df, ["page"])
    assert [r.cluster_ix for r in c.orderBy("seg_ix").collect()] == [0, 0, 1, 2]
    assert layout.table_like_lines(c, ["page"]).count() == 0
    assert [r.column for r in layout.nearest_column(df, [0.0, 60.0, 400.0]).orderBy("seg_ix").collect()] == [0, 0, 1, 2]


# Files


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("Article,Tarif\nThé,18.75\n", encoding="utf-8")
    (tmp_path / "in" / "sub" / "b.md").write_text("# Titre\n\ntexte", encoding="utf-8")
    df = manager.open_documents(spark, str(tmp_path / "in"))
    assert sorted(r.format for r in df.collect()) == ["csv", "md"]
    for fmt in ("html", "pdf", "xlsx"):
        out = {r.path for r in manager.convert(spark, str(tmp_path / "in"), str(tmp_path / fmt), fmt).collect()}
        assert len(out) == 2 and all(p.endswith(fmt) for p in out)
        names = sorted(str(p.relative_to(tmp_path / fmt)) for p in (tmp_path / fmt).rglob("*.*"))
        assert names == [f"a.{fmt}", f"sub/b.{fmt}"]
    back = sources.read(spark, str(tmp_path / "xlsx"))
    assert back.where(F.array_contains(F.transform(F.col("sections")[0]["elements"][0]["table"]["rows"], lambda r: r["cells"][0]["text"]), "Thé")).count() == 1
    assert {r.path.rpartition(".")[2] for r in manager.save(df, str(tmp_path / "own")).collect()} == {"csv", "md"}
    thumbs = manager.thumbnail(spark, str(tmp_path / "in")).collect()
    assert all(t.thumbnail.mime_type == "image/png" and t.data_uri.startswith("data:image/png;base64,") for t in thumbs)


def test_files_of_one_name(spark, tmp_path):
    for k, folder in enumerate(("x", "y")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.csv").write_text(f"k\n{k}")
    out = {r.path for r in manager.convert(spark, str(tmp_path / "in"), str(tmp_path / "md"), "md").collect()}
    assert len(out) == 2 and [(tmp_path / "md" / f / "same.md").read_text().count(str(k)) for k, f in enumerate("xy")] == [1, 1]
    df = sources.read(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="same.md"):
        manager.save(df, str(tmp_path / "flat"), "md")
    assert len({r.path for r in manager.save(df, str(tmp_path / "deep"), "md", base=str(tmp_path / "in")).collect()}) == 2
    (tmp_path / "in" / "x" / "same.md").write_text("two formats of one name")
    with pytest.raises(ValueError, match="same.pdf"):
        manager.convert(spark, str(tmp_path / "in"), str(tmp_path / "pdf"), "pdf")
    assert not (tmp_path / "pdf").exists()


def test_sheets_hold_every_row():
    doc = m.document("csv", "t", [m.section("data", [m.table([(False, [str(k)]) for k in range(70_000)])])])
    back = parse("t.xls", binary.render_xls(doc))
    got = [r["cells"][0]["text"] for s in back["sections"] for e in s["elements"] for r in e["table"]["rows"]]
    assert got == [str(k) for k in range(70_000)] and len(back["sections"]) == 2
    with pytest.raises(ValueError, match="300 columns"):
        binary.render_xls(m.document("csv", "t", [m.section("data", [m.table([(False, ["x"] * 300)])])]))
    with pytest.raises(ValueError, match="characters"):
        binary.render_xls(m.document("csv", "t", [m.section("data", [m.table([(False, ["x" * 70_000])])])]))
    long = parse("t.xls", binary.render_xls(m.document("csv", "t", [m.section("data", [m.table([(False, ["y" * 60_000])])])])))
    assert rows(long) == [["y" * 60_000]]


def test_sheet_limit_says_what_it_drops():
    data = binary.render_xlsx(m.document("csv", "t", [m.section("small", [m.table([(False, ["1"])])]), m.section("large", [m.table([(False, [str(k)]) for k in range(5000)])])]))
    whole, cut = parse("t.xlsx", data), parse("t.xlsx", data, sheet_limit=20_000)
    assert len(whole["sections"]) == 2 and "sheets_left_out" not in whole["metadata"]
    assert len(cut["sections"]) == 1 and cut["metadata"]["sheets_left_out"] == "large"


def test_tables_in_parts(spark):
    df = m.table_of(spark.range(25), "id", "n", by=F.floor(F.col("id") / 10))
    got = {r.doc_id: r.n for r in m.table_rows(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"n-0": 11, "n-1": 11, "n-2": 6}


def test_registries(spark):
    sources.register_parser("txt", lambda data, name="", **_: m.document("txt", "t", [m.section("s", [m.paragraph(data.decode())])]))
    sinks.register_renderer("shout", lambda doc: doc["title"].upper().encode())
    try:
        df = sources.parse_files(spark.createDataFrame([("n.txt", b"bonjour")], "path string, content binary"))
        assert sinks.render(df, "shout").first().content == b"T" and "txt" in sources.supported_extensions()
    finally:
        sources.PARSERS.pop("txt")
        sinks.BINARY.pop("shout")


def test_data_source(spark, tmp_path):
    from vellum.sources import datasource

    datasource.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2")
    (tmp_path / "in" / "b.pdf").write_text("broken")
    df = spark.read.format("vellum").load(str(tmp_path / "in"))
    assert sorted((r.format, r.error is None) for r in df.collect()) == [("csv", True), ("pdf", False)]
    df.where("error IS NULL").write.format("vellum").option("format", "xlsx").mode("append").save(str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.xlsx"]
    assert rows(parse("a.xlsx", (tmp_path / "out" / "a.xlsx").read_bytes())) == [["x", "y"], ["1", "2"]]
    spark.createDataFrame([("p.html", b"<body><h1>T</h1><p>a</p></body>")], "path string, content binary").createOrReplaceTempView("files_in")
    got = spark.sql("SELECT t.type, t.text FROM files_in, LATERAL parse_document(path, content) t ORDER BY t.element_ix").collect()
    assert [tuple(r) for r in got] == [("paragraph", "T"), ("paragraph", "a")]


def test_json_form(spark):
    import json

    doc = json.loads(m.to_json(m.documents(spark, [report()])).first().json)
    assert doc["format"] == "md" and list(doc) == ["format", "title", "metadata", "sections"]
    first, last = doc["sections"]
    assert list(first) == ["name", "elements"] and first["elements"][0]["style"]["headingLevel"] == 1 and first["elements"][1]["runs"][0] == {"text": "Ventes ", "style": None}
    assert first["elements"][2]["rows"][1]["cells"][1]["text"] == "73400" and first["elements"][2]["rows"][0]["isHeader"] is True and first["elements"][2]["style"] is None
    assert last["elements"][1] == {"type": "page_break"} and last["elements"][2]["src"] == "/logo.png" and last["elements"][2]["dataSize"] == 0 and "dataUri" not in last["elements"][2]


def test_document_thumbnails(spark):
    from vellum.providers import thumbnails

    got = {r.doc_id: r.thumbnail for r in thumbnails.of_documents(m.documents(spark, [report()])).collect()}
    assert got["report.md"].mime_type == "image/png"


def test_files_that_share_a_batch(spark, monkeypatch):
    def odd(data, name="", **_):
        return m.document("odd", "t", metadata={"k": 1} if data == b"misfit" else {})

    monkeypatch.setitem(sources.PARSERS, "odd", odd)
    names = [f"{k}.{'odd' if k % 3 else 'html'}" for k in range(1200)] + ["x.none", "big.html"]
    texts = [b"misfit" if k % 100 == 1 else f"<p>{k}</p>".encode() for k in range(1200)] + [b"", b"<p>" + b"y" * 600_000 + b"</p>"]
    files = spark.createDataFrame([(n, bytearray(t)) for n, t in zip(names, texts)], "path string, content binary").coalesce(1)
    got = {r.doc_id: r for r in sources.parse_files(files).collect()}
    assert list(got) == names
    bad = {n for n, t in zip(names, texts) if t == b"misfit" and n.endswith("odd")} | {"x.none"}
    assert {n for n, r in got.items() if r.error} == bad and len(bad) > 1
    assert all(got[f"{k}.html"].sections[0].elements[0].text == str(k) for k in range(0, 1200, 3) if k % 100 != 1)
    assert len(got["big.html"].sections[0].elements[0].text) == 600_000
