"""The document model: one fixed schema, builders for its rows, and the relational views over it.

A document is a row; its sections, elements, runs, rows and cells are nested arrays, so writing one format from another
needs no shuffle. `views` explodes them, with the order as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEXT_STYLE = "struct<font_family:string,font_size:double,color:string,bold:boolean,italic:boolean,underline:boolean>"
PARA_STYLE = "struct<alignment:string,space_before:double,space_after:double,line_spacing:double,heading_level:int>"
TABLE_STYLE = "struct<alignment:string,border_style:string,border_width:double,border_color:string,cell_padding:double,header_bg:string,striped_bg:string>"
RUN = f"struct<text:string,style:{TEXT_STYLE}>"
CELL = f"struct<text:string,runs:array<{RUN}>,colspan:int,rowspan:int>"
ROW = f"struct<is_header:boolean,cells:array<{CELL}>>"
PARAGRAPH = f"struct<style:{PARA_STYLE},runs:array<{RUN}>>"
TABLE = f"struct<style:{TABLE_STYLE},column_widths:array<double>,rows:array<{ROW}>>"
IMAGE = "struct<src:string,width:int,height:int,alt:string,mime_type:string,data:binary>"
ELEMENT = f"struct<type:string,text:string,paragraph:{PARAGRAPH},table:{TABLE},image:{IMAGE}>"
SECTION = f"struct<name:string,metadata:map<string,string>,elements:array<{ELEMENT}>>"
DOCUMENT = f"doc_id string, source_file string, format string, title string, metadata map<string,string>, default_style {TEXT_STYLE}, sections array<{SECTION}>, error string"


def schema() -> StructType:
    return StructType.fromDDL(DOCUMENT)


# Builders of rows, as plain dicts


def text_style(**given) -> dict:
    return {"font_family": "Helvetica", "font_size": 12.0, "color": "#000000", "bold": False, "italic": False, "underline": False} | given


def para_style(**given) -> dict:
    return {"alignment": "left", "space_before": 0.0, "space_after": 6.0, "line_spacing": 1.15, "heading_level": None} | given


def table_style(**given) -> dict:
    return {"alignment": "left", "border_style": "solid", "border_width": 0.5, "border_color": "#000000", "cell_padding": 4.0, "header_bg": "#f3f4f6", "striped_bg": None} | given


def run(text: str, style: dict | None = None) -> dict:
    return {"text": text, "style": style}


def paragraph(runs: list[dict] | str, style: dict | None = None) -> dict:
    runs = [run(runs)] if isinstance(runs, str) else runs
    return {"type": "paragraph", "text": "".join(r["text"] for r in runs), "paragraph": {"style": style, "runs": runs}, "table": None, "image": None}


#: Sizes of headings of level 1, 2, 3; deeper ones have the last (fixed).
HEADING_SIZES = (24.0, 20.0, 16.0, 14.0)


def heading(text: str, level: int) -> dict:
    return paragraph([run(text, text_style(bold=True, font_size=HEADING_SIZES[min(level, 4) - 1]))], para_style(heading_level=level))


def cell(content: str | list[dict], colspan: int = 1, rowspan: int = 1) -> dict:
    runs = [run(content)] if isinstance(content, str) else content
    return {"text": "".join(r["text"] for r in runs), "runs": runs, "colspan": colspan, "rowspan": rowspan}


def table(rows: list[tuple[bool, list]], style: dict | None = None, widths: list[float] | None = None) -> dict:
    """rows: (is_header, cells), a cell being a text or what `cell` gives."""
    made = [{"is_header": h, "cells": [c if isinstance(c, dict) else cell(c) for c in cells]} for h, cells in rows]
    return {"type": "table", "text": None, "paragraph": None, "table": {"style": style, "column_widths": widths or [], "rows": made}, "image": None}


def image(src: str = "", width: int = 0, height: int = 0, alt: str = "", data: bytes | None = None, mime_type: str | None = None) -> dict:
    return {"type": "image", "text": None, "paragraph": None, "table": None, "image": {"src": src, "width": width, "height": height, "alt": alt, "mime_type": mime_type, "data": data}}


def image_from_data(data: bytes, mime_type: str, name: str = "image") -> dict:
    ext = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tiff", "image/svg+xml": "svg"}.get(mime_type, "bin")
    return image(f"{name}.{ext}", data=data, mime_type=mime_type)


def page_break() -> dict:
    return {"type": "page_break", "text": None, "paragraph": None, "table": None, "image": None}


def section(name: str, elements: list[dict] | None = None, metadata: dict | None = None) -> dict:
    return {"name": name, "metadata": metadata or {}, "elements": elements or []}


def document(fmt: str, title: str = "", sections: list[dict] | None = None, metadata: dict | None = None, doc_id: str = "", source_file: str = "", error: str | None = None) -> dict:
    return {"doc_id": doc_id, "source_file": source_file, "format": fmt, "title": title, "metadata": metadata or {}, "default_style": text_style(), "sections": sections or [], "error": error}


def documents(spark, docs: list[dict]) -> DataFrame:
    """A DataFrame of built documents."""
    return spark.createDataFrame(docs, schema())


def blank(spark, fmt: str, title: str = "") -> DataFrame:
    return documents(spark, [document(fmt, title, doc_id=title or "blank")])


def remove_section(df: DataFrame, index: int) -> DataFrame:
    return df.withColumn("sections", F.filter("sections", lambda _, i: i != index))


# Formats

# Extensions of each format, and its MIME type.
EXTENSIONS = {
    "pdf": ("pdf",),
    "html": ("html", "htm"),
    "csv": ("csv", "tsv"),
    "docx": ("docx",),
    "doc": ("doc",),
    "md": ("md", "markdown", "mkd", "mdown"),
    "xlsx": ("xlsx",),
    "xls": ("xls",),
    "pptx": ("pptx",),
    "ppt": ("ppt",),
    "odt": ("odt",),
    "ods": ("ods",),
    "odp": ("odp",),
    "rtf": ("rtf",),
    "txt": ("txt",),
}
MIME_TYPES = {
    "pdf": "application/pdf",
    "html": "text/html",
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "md": "text/markdown",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "rtf": "application/rtf",
    "txt": "text/plain",
}
OFFICE = ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf")
TEXT_BASED = ("html", "csv", "md", "txt")


def format_of(extension: Column) -> Column:
    """The format of a file extension; null for an unknown one."""
    e = F.lower(F.btrim(extension, F.lit(".")))
    return F.coalesce(*[F.when(e.isin(*x), F.lit(f)) for f, x in EXTENSIONS.items()])


def mime_of(fmt: Column) -> Column:
    return F.coalesce(*[F.when(fmt == f, F.lit(m)) for f, m in MIME_TYPES.items()])


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def formats(spark) -> DataFrame:
    return spark.createDataFrame([(f, e, MIME_TYPES[f], f in OFFICE, f in TEXT_BASED) for f, es in EXTENSIONS.items() for e in es], "format string, extension string, mime_type string, is_office boolean, is_text boolean")


# Views


def sections(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode("sections").alias("section_ix", "s")).select("doc_id", "section_ix", "s.*")


def elements(df: DataFrame) -> DataFrame:
    s = df.select("doc_id", F.posexplode("sections").alias("section_ix", "s"))
    return s.select("doc_id", "section_ix", F.posexplode("s.elements").alias("element_ix", "e")).select("doc_id", "section_ix", "element_ix", "e.*")


def runs(df: DataFrame) -> DataFrame:
    e = elements(df).where("type = 'paragraph'")
    return e.select("doc_id", "section_ix", "element_ix", F.posexplode("paragraph.runs").alias("run_ix", "r")).select("doc_id", "section_ix", "element_ix", "run_ix", "r.text", "r.style")


def table_rows(df: DataFrame) -> DataFrame:
    e = elements(df).where("type = 'table'")
    return e.select("doc_id", "section_ix", "element_ix", F.posexplode("table.rows").alias("row_ix", "r")).select("doc_id", "section_ix", "element_ix", "row_ix", "r.is_header", "r.cells")


def cells(df: DataFrame) -> DataFrame:
    r = table_rows(df)
    return r.select("doc_id", "section_ix", "element_ix", "row_ix", "is_header", F.posexplode("cells").alias("col_ix", "c")).select("doc_id", "section_ix", "element_ix", "row_ix", "is_header", "col_ix", "c.text", "c.colspan", "c.rowspan")


def register_views(df: DataFrame, prefix: str = "") -> None:
    """documents, sections, elements, runs, table_rows and cells for spark.sql."""
    for name, view in (("documents", df), ("sections", sections(df)), ("elements", elements(df)), ("runs", runs(df)), ("table_rows", table_rows(df)), ("cells", cells(df))):
        view.createOrReplaceTempView(f"{prefix}{name}")


def column_count(table_rows_col) -> Column:
    """The cells of the longest row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(table_rows_col, lambda r: F.size(r["cells"]))), F.lit(0))


def table_of(df: DataFrame, order: str, name: str = "data", fmt: str = "csv", columns: list[str] | None = None, by: Column | None = None) -> DataFrame:
    """Documents `name-<by>`, each with one table of df's rows of a value of `by` in the order of a column, all cells text.

    Without `by` it is one document `name`, gathered in one task: for tables that fit a document. A larger table takes a
    `by` of bounded parts, such as ranges of its key.
    """
    columns = columns or df.columns
    title = F.concat(F.lit(f"{name}-"), by.cast("string")) if by is not None else F.lit(name)
    as_cell = lambda c: F.struct(c.alias("text"), F.array(F.struct(c.alias("text"), F.lit(None).cast(TEXT_STYLE).alias("style"))).alias("runs"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    row = F.struct(F.lit(False).alias("is_header"), F.array(*[as_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("cells"))
    head = F.array(F.struct(F.lit(True).alias("is_header"), F.array(*[as_cell(F.lit(c)) for c in columns]).alias("cells")))
    body = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    made = F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(PARAGRAPH).alias("paragraph"), F.struct(F.lit(None).cast(TABLE_STYLE).alias("style"), F.array().cast("array<double>").alias("column_widths"), F.concat(head, F.col("body")).alias("rows")).alias("table"), F.lit(None).cast(IMAGE).alias("image"))
    sec = F.struct(F.lit(name).alias("name"), F.create_map().cast("map<string,string>").alias("metadata"), F.array(made).alias("elements"))
    style = F.struct(*[F.lit(v).alias(k) for k, v in text_style().items()])
    parts = df.groupBy(title.alias("title")).agg(body.alias("body")) if by is not None else df.agg(body.alias("body")).select(title.alias("title"), "body")
    return parts.select("title", F.array(sec).alias("sections")).select(F.col("title").alias("doc_id"), F.lit("").alias("source_file"), F.lit(fmt).alias("format"), "title", F.create_map().cast("map<string,string>").alias("metadata"), style.alias("default_style"), "sections", F.lit(None).cast("string").alias("error"))


# Derived columns


def plain_text(sections_col="sections") -> Column:
    """Texts of all paragraphs and cells in document order, a line each."""
    of_element = lambda e: F.when(e["type"] == "table", F.array_join(F.transform(e["table"]["rows"], lambda r: F.array_join(F.transform(r["cells"], lambda c: c["text"]), "\t")), "\n")).otherwise(F.coalesce(e["text"], F.lit("")))
    return F.array_join(F.flatten(F.transform(sections_col, lambda s: F.filter(F.transform(s["elements"], of_element), lambda t: t != ""))), "\n")


def first_image(sections_col="sections") -> Column:
    """The first image in document order, or null."""
    return F.get(F.flatten(F.transform(sections_col, lambda s: F.transform(F.filter(s["elements"], lambda e: e["type"] == "image"), lambda e: e["image"]))), F.lit(0))


def data_uri(image_col: Column) -> Column:
    return F.when(image_col["data"].isNotNull(), F.concat(F.lit("data:"), F.coalesce(image_col["mime_type"], F.lit("application/octet-stream")), F.lit(";base64,"), F.base64(image_col["data"])))


def data_size(image_col: Column) -> Column:
    return F.coalesce(F.octet_length(image_col["data"]), F.lit(0))


def needs_ocr(elements_col: Column, least_text_ratio: float = 0.1) -> Column:
    """A section with an image whose paragraphs are less than the ratio of its elements."""
    count = lambda kind: F.size(F.filter(elements_col, lambda e: e["type"] == kind))
    return (count("image") > 0) & (count("paragraph") / F.greatest(F.size(elements_col), F.lit(1)) < least_text_ratio)


def pdf_font(style: Column) -> Column:
    """The base font of a style: family by bold and italic."""
    family = F.lower(F.coalesce(style["font_family"], F.lit("")))
    slant = lambda plain, bold, italic, both: F.when(style["bold"] & style["italic"], both).when(style["bold"], bold).when(style["italic"], italic).otherwise(plain)
    times = slant("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic")
    courier = slant("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")
    return F.when(family.contains("times") | (family == "serif"), times).when(family.contains("courier") | (family == "monospace"), courier).otherwise(slant("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"))


def _camel(struct: Column, names: dict[str, str]) -> Column:
    return F.when(struct.isNotNull(), F.struct(*[struct[k].alias(v) for k, v in names.items()]))


TEXT_NAMES = {"font_family": "fontFamily", "font_size": "fontSize", "color": "color", "bold": "bold", "italic": "italic", "underline": "underline"}
PARA_NAMES = {"alignment": "alignment", "space_before": "spaceBefore", "space_after": "spaceAfter", "line_spacing": "lineSpacing", "heading_level": "headingLevel"}
TABLE_NAMES = {"alignment": "alignment", "border_style": "borderStyle", "border_width": "borderWidth", "border_color": "borderColor", "cell_padding": "cellPadding", "header_bg": "headerBg", "striped_bg": "stripedBg"}


def to_json(df: DataFrame) -> DataFrame:
    """(doc_id, json) in the interchange form: keys by kind of element, null styles as null, an image's bytes as a data URI;
    the default style is not in it."""
    text = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    of_runs = lambda rs: F.transform(rs, lambda r: F.struct(r["text"].alias("text"), _camel(r["style"], TEXT_NAMES).alias("style")))
    in_cell = lambda c: F.array(F.struct(F.lit("paragraph").alias("type"), c["text"].alias("text"), of_runs(c["runs"]).alias("runs"), F.lit(None).cast("string").alias("style")))
    of_cell = lambda c: F.struct(c["text"].alias("text"), in_cell(c).alias("elements"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))

    def of_element(e):
        p, t, i, kind = e["paragraph"], e["table"], e["image"], e["type"].alias("type")
        rows = F.transform(t["rows"], lambda r: F.struct(r["is_header"].alias("isHeader"), F.transform(r["cells"], of_cell).alias("cells")))
        image = [kind, *(i[k].alias(k) for k in ("src", "width", "height", "alt")), i["mime_type"].alias("mimeType"), data_size(i).alias("dataSize")]
        return (
            F.when(e["type"] == "paragraph", text(kind, e["text"].alias("text"), of_runs(p["runs"]).alias("runs"), _camel(p["style"], PARA_NAMES).alias("style")))
            .when(e["type"] == "table", text(kind, rows.alias("rows"), t["column_widths"].alias("columnWidths"), _camel(t["style"], TABLE_NAMES).alias("style")))
            .when((e["type"] == "image") & i["data"].isNotNull(), text(*image, data_uri(i).alias("dataUri")))
            .when(e["type"] == "image", text(*image))
            .otherwise(text(kind))
        )

    open_object = lambda c: F.regexp_replace(c, r"\}$", "")

    def of_section(s):
        meta = F.when(F.size(s["metadata"]) > 0, F.concat(F.lit(',"metadata":'), F.to_json(s["metadata"]))).otherwise("")
        return F.concat(open_object(text(s["name"].alias("name"))), F.lit(',"elements":['), F.array_join(F.transform(s["elements"], of_element), ","), F.lit("]"), meta, F.lit("}"))

    made = F.array_join(F.transform("sections", of_section), ",")
    return df.select("doc_id", F.concat(open_object(text("format", "title", "metadata")), F.lit(',"sections":['), made, F.lit("]}")).alias("json"))
