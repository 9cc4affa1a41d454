"""CSV, Markdown and HTML as Column expressions over a document's sections: no Python on the executors, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as m
from ..functions import escape_html, escape_pipes, trim


def _number(c) -> Column:
    """12.0 as 12, 1.15 as it is."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _join(parts, sep: str = "") -> Column:
    return F.array_join(parts, sep)


def _by_type(e, paragraph, table, image, page_break) -> Column:
    return F.when(e["type"] == "paragraph", paragraph).when(e["type"] == "table", table).when(e["type"] == "image", image).when(e["type"] == "page_break", page_break)


def _level(paragraph) -> Column:
    return F.when(paragraph["style"]["heading_level"].between(1, 6), paragraph["style"]["heading_level"])


def _source(image) -> Column:
    """An image's src, or its bytes as a data URI if it has none."""
    return F.coalesce(F.when(F.coalesce(image["src"], F.lit("")) == "", m.data_uri(image)), image["src"], F.lit(""))


# CSV


def csv_field(c, delimiter: str = ",", quote: str = '"') -> Column:
    """Quoted if it has the delimiter, the quote, white space or a line end; quotes are doubled."""
    risky = reduce(lambda a, x: a | c.contains(x), [quote, "\n", "\r", "\t", " "], c.contains(delimiter))
    return F.when(risky, F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(c)


def render_csv(sections="sections", delimiter: str = ",", quote: str = '"', bom: bool = True) -> Column:
    """Rows of tables, and paragraphs that are not blank as rows of one field; images and breaks are left out."""
    field = lambda c: csv_field(F.coalesce(c, F.lit("")), delimiter, quote)
    row = lambda r: F.concat(_join(F.transform(r["cells"], lambda c: field(c["text"])), delimiter), F.lit("\n"))
    of = lambda e: _by_type(e, F.when(trim(e["text"]) != "", F.concat(field(e["text"]), F.lit("\n"))).otherwise(""), _join(F.transform(e["table"]["rows"], row)), F.lit(""), F.lit(""))
    return F.concat(F.lit("﻿" if bom else ""), _join(F.flatten(F.transform(sections, lambda s: F.transform(s["elements"], of)))))


# Markdown


def _md_runs(runs, plain_bold: bool = False, heading=None) -> Column:
    def one(r):
        s, t = r["style"], r["text"]
        bold = F.coalesce(s["bold"], F.lit(False)) & (F.lit(True) if heading is None else heading.isNull())
        italic, under = F.coalesce(s["italic"], F.lit(False)), F.coalesce(s["underline"], F.lit(False))
        mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
        inner = F.concat(mark, t, mark)
        return F.when(t == "", "").otherwise(F.when(under, F.concat(F.lit("<u>"), inner, F.lit("</u>"))).otherwise(inner))

    return _join(F.transform(runs, one))


def _md_table(table) -> Column:
    """Rows padded to the widest; the rule stands after the first row, whatever it is."""
    width = m.column_count(table["rows"])
    cell = lambda c: escape_pipes(_md_runs(c["runs"]))
    line = lambda r: F.concat(F.lit("|"), _join(F.transform(r["cells"], lambda c: F.concat(F.lit(" "), cell(c), F.lit(" |")))), F.repeat(F.lit("  |"), width - F.size(r["cells"])), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width), F.lit("\n"))
    return _join(F.transform(table["rows"], lambda r, i: F.concat(line(r), F.when(i == 0, rule).otherwise(""))))


def render_markdown(sections="sections", metadata="metadata") -> Column:
    head = F.concat(F.lit("---\n"), _join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")))), F.lit("---\n"))

    def of(e):
        p, level = e["paragraph"], _level(e["paragraph"])
        para = F.concat(F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise(""), _md_runs(p["runs"], heading=level), F.lit("\n\n"))
        image = F.concat(F.lit("!["), F.coalesce(e["image"]["alt"], F.lit("")), F.lit("]("), _source(e["image"]), F.lit(")\n\n"))
        return _by_type(e, para, F.concat(_md_table(e["table"]), F.lit("\n")), image, F.lit("---\n\n"))

    body = F.transform(sections, lambda s: _join(F.transform(s["elements"], of)))
    front = F.when(F.coalesce(F.size(F.map_keys(metadata)), F.lit(0)) > 0, F.array(head)).otherwise(F.array().cast("array<string>"))
    return _join(F.concat(front, body), "\n")


# HTML

STYLE_SHEET = (
    "*{box-sizing:border-box;margin:0;padding:0} body{line-height:1.6} section{margin-bottom:2em} "
    "table{border-collapse:collapse;width:100%;margin:1em 0} th,td{border:1px solid #d1d5db;padding:8px 12px;text-align:left} "
    "th{background:#f3f4f6;font-weight:600} img{max-width:100%;height:auto} "
    ".page-break{page-break-after:always;border-top:2px dashed #d1d5db;margin:2em 0}"
)


def _css(*parts) -> Column:
    """name:value pairs that are there, joined by semicolons."""
    return F.concat_ws(";", *parts)


def _html_run(r) -> Column:
    s = r["style"]
    css = _css(
        F.concat(F.lit("font-family:"), escape_html(s["font_family"]), F.lit(",sans-serif")),
        F.concat(F.lit("font-size:"), _number(s["font_size"]), F.lit("pt")),
        F.concat(F.lit("color:"), escape_html(s["color"])),
        F.when(s["bold"], "font-weight:bold"),
        F.when(s["italic"], "font-style:italic"),
        F.when(s["underline"], "text-decoration:underline"),
    )
    text = escape_html(r["text"])
    return F.when(s.isNull(), text).otherwise(F.concat(F.lit('<span style="'), css, F.lit('">'), text, F.lit("</span>")))


def _html_paragraph(p) -> Column:
    s, level = p["style"], _level(p)
    css = _css(
        F.concat(F.lit("text-align:"), s["alignment"]),
        F.when(s["space_before"] > 0, F.concat(F.lit("margin-top:"), _number(s["space_before"]), F.lit("pt"))),
        F.when(s["space_after"] > 0, F.concat(F.lit("margin-bottom:"), _number(s["space_after"]), F.lit("pt"))),
        F.when(s["line_spacing"] != 1.0, F.concat(F.lit("line-height:"), F.format_string("%.2f", s["line_spacing"]))),
    )
    attr = F.when(s.isNull(), "").otherwise(F.concat(F.lit(' style="'), css, F.lit('"')))
    tag = F.when(level.isNotNull(), F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    return F.concat(F.lit("<"), tag, attr, F.lit(">"), _join(F.transform(p["runs"], _html_run)), F.lit("</"), tag, F.lit(">\n"))


def _html_table(t) -> Column:
    s, rows = t["style"], t["rows"]
    css = _css(
        F.concat(F.lit("border-color:"), escape_html(s["border_color"])),
        F.when(s["border_width"] > 0, F.concat(F.lit("border-width:"), _number(s["border_width"]), F.lit("px"))),
        F.concat(F.lit("border-style:"), s["border_style"]),
        F.when(s["cell_padding"] > 0, F.concat(F.lit("--cell-padding:"), _number(s["cell_padding"]), F.lit("pt"))),
    )
    attr = F.when(s.isNull(), "").otherwise(F.concat(F.lit(' style="'), css, F.lit('"')))
    heads = F.filter(F.transform(rows, lambda r, i: F.when(r["is_header"], i)), lambda i: i.isNotNull())

    def span(c, name):
        return F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), c[name].cast("string"), F.lit('"'))).otherwise("")

    def row(r, i):
        tag = F.when(r["is_header"], "th").otherwise("td")
        nth = i - F.size(F.filter(heads, lambda h: h < i))
        paint = F.when(r["is_header"], s["header_bg"]).when(nth % 2 == 1, s["striped_bg"])
        colour = F.when(paint.isNotNull(), F.concat(F.lit(' style="background:'), escape_html(paint), F.lit('"'))).otherwise("")
        cells = F.transform(r["cells"], lambda c: F.concat(F.lit("<"), tag, span(c, "colspan"), span(c, "rowspan"), F.lit(">"), _join(F.transform(c["runs"], _html_run)), F.lit("</"), tag, F.lit(">")))
        return F.concat(F.lit("<tr"), colour, F.lit(">"), _join(cells), F.lit("</tr>\n"))

    made = F.transform(rows, row)
    first = F.array_position(F.transform(rows, lambda r: F.coalesce(r["is_header"], F.lit(False))), False)
    n_head = F.when(first == 0, F.size(rows)).otherwise(first - 1).cast("int")
    parted = F.concat(F.lit("<thead>\n"), _join(F.slice(made, 1, n_head)), F.lit("</thead>\n<tbody>\n"), _join(F.slice(made, n_head + 1, F.size(rows))), F.lit("</tbody>\n"))
    return F.concat(F.lit("<table"), attr, F.lit(">\n"), F.when(n_head > 0, parted).otherwise(_join(made)), F.lit("</table>\n"))


def _html_image(i) -> Column:
    size = lambda k: F.when(i[k] > 0, F.concat(F.lit(f' {k}="'), i[k].cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<figure><img src="'), escape_html(_source(i)), F.lit('" alt="'), escape_html(F.coalesce(i["alt"], F.lit(""))), F.lit('"'), size("width"), size("height"), F.lit("></figure>\n"))


def render_html(title="title", sections="sections", default_style="default_style", lang: str = "fr") -> Column:
    of = lambda e: _by_type(e, _html_paragraph(e["paragraph"]), _html_table(e["table"]), _html_image(e["image"]), F.lit('<div class="page-break"></div>\n'))
    body = _join(F.transform(sections, lambda s: F.concat(F.lit('<section id="'), escape_html(s["name"]), F.lit('">\n'), _join(F.transform(s["elements"], of)), F.lit("</section>\n"))))
    s = F.col(default_style)
    css = F.concat(F.lit("font-family:"), escape_html(s["font_family"]), F.lit(",sans-serif;font-size:"), _number(s["font_size"]), F.lit("pt;color:"), escape_html(s["color"]), F.lit(";max-width:800px;margin:0 auto;padding:40px 20px;"))
    head = f'<!DOCTYPE html>\n<html lang="{lang}">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>'
    return F.concat(F.lit(head), escape_html(F.col(title)), F.lit(f"</title>\n<style>{STYLE_SHEET}</style>\n</head>\n<body style=\""), css, F.lit('">\n'), body, F.lit("</body>\n</html>\n"))


def doc_text(sections="sections") -> Column:
    """Paragraphs and rows, each ended by a return, cells parted by tabs: the text part of a DOC file."""
    of = lambda e: _by_type(e, F.array(e["text"]), F.transform(e["table"]["rows"], lambda r: _join(F.transform(r["cells"], lambda c: c["text"]), "\t")), F.array().cast("array<string>"), F.array().cast("array<string>"))
    text = _join(F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["elements"], of)))), "\r")
    return F.when((text != "") & ~text.endswith("\r"), F.concat(text, F.lit("\r"))).otherwise(text)
