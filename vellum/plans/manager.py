"""One entry for documents: create, open, save, render, convert, thumbnail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model, sinks, sources
from ..providers import llm as language_models
from ..providers import ocr as ocr_engines
from ..providers import thumbnails as previews
from .pipeline import Pipeline, from_config

create = model.blank
register_parser = sources.register_parser
register_renderer = sinks.register_renderer


def open_documents(spark: SparkSession, *paths: str, ocr: bool | str = False, language: str = "auto", engine=None, pipeline: Pipeline | None = None, config: dict | None = None, llm=None, **options) -> DataFrame:
    """Documents of files and folders; with ocr True or 'auto' images are read by the engine, with llm by its client too.

    What is given here counts over config, config over the defaults.
    """
    config = config or {}
    df = sources.read(spark, *paths, **options)
    mode = ocr if ocr is not False else config.get("ocr", {}).get("mode", False)
    if mode is False:
        return df
    settings = config.get("ocr", {})
    engine = engine or ocr_engines.CommandOcr(settings.get("binary", "tesseract"), tuple(settings.get("options", ())), settings.get("timeout", 60))
    pipeline = pipeline or from_config(settings.get("post_processing", {}))
    df = ocr_engines.ocr(df, engine, mode, settings.get("language", language) if language == "auto" else language, settings.get("min_text_ratio", 0.1), pipeline)
    if llm is not None:
        df = structure_read_sections(df, llm)
    return df


open_batch = open_documents


def structure_read_sections(df: DataFrame, client) -> DataFrame:
    """Sections that OCR has read get the content that the client makes of their text, and its confidence as metadata."""
    s = model.sections(df).where(F.col("metadata")["ocr_processed"] == "true")
    pages = s.select("doc_id", "section_ix", F.array_join(F.filter(F.transform("elements", lambda e: e["text"]), lambda t: t.isNotNull()), "\n\n").alias("text"))
    made = language_models.structure(pages, client, ["doc_id", "section_ix"])
    plain = lambda t: F.array(F.struct(t.alias("text"), F.lit(None).cast(model.TEXT_STYLE).alias("style")))
    none = {k: F.lit(None).cast(v).alias(k) for k, v in (("paragraph", model.PARAGRAPH), ("table", model.TABLE), ("image", model.IMAGE))}
    para = lambda t, style=None: F.struct(F.lit("paragraph").alias("type"), t.alias("text"), F.struct((style if style is not None else F.lit(None).cast(model.PARA_STYLE)).alias("style"), plain(t).alias("runs")).alias("paragraph"), none["table"], none["image"])
    heading = F.struct(*[(F.lit(1) if k == "heading_level" else F.lit(v)).alias(k) for k, v in model.para_style().items()])
    cell = lambda c: F.struct(c.alias("text"), plain(c).alias("runs"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    grid = lambda t: F.struct(F.lit(None).cast(model.TABLE_STYLE).alias("style"), F.array().cast("array<double>").alias("column_widths"), F.transform(t, lambda r, i: F.struct((i == 0).alias("is_header"), F.transform(r, cell).alias("cells"))).alias("rows"))
    table = lambda t: F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), none["paragraph"], grid(t).alias("table"), none["image"])
    empty = F.array().cast(f"array<{model.ELEMENT}>")
    page = F.col("page")
    parts = F.concat(
        F.when(page["title"] != "", F.array(para(page["title"], heading)).cast(f"array<{model.ELEMENT}>")).otherwise(empty),
        F.transform(F.filter(page["paragraphs"], lambda p: F.trim(p) != ""), lambda p: para(p)).cast(f"array<{model.ELEMENT}>"),
        F.transform(F.filter(page["tables"], lambda t: F.size(t) > 0), table).cast(f"array<{model.ELEMENT}>"),
    )
    new = made.select("doc_id", "section_ix", F.struct(parts.alias("elements"), page["confidence"].cast("string").alias("confidence")).alias("p"))
    new = new.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_ix", "p"))).alias("_new"))

    def renewed(s, i):
        found = F.try_element_at("_new", i)
        meta = F.map_concat(F.map_filter(s["metadata"], lambda k, _: k != "ocr_confidence"), F.create_map(F.lit("ocr_confidence"), found["confidence"]))
        return F.when(found.isNull(), s).otherwise(F.struct(s["name"].alias("name"), meta.alias("metadata"), found["elements"].alias("elements")))

    out = df.join(new, "doc_id", "left")
    return out.withColumn("sections", F.when(F.col("_new").isNull(), F.col("sections")).otherwise(F.transform("sections", renewed))).select(*df.columns)


def save(df: DataFrame, folder: str, fmt: str | None = None, **options) -> DataFrame:
    """Files of the documents, in a format or each in its own; (doc_id, path)."""
    if fmt:
        return sinks.save(df, folder, fmt, **options)  # base: the folder that documents' paths are taken below
    out = None
    for f in [r.format for r in df.select("format").distinct().limit(len(model.EXTENSIONS)).collect()]:  # one name for each format there is
        part = sinks.save(df.where(F.col("format") == f), folder, f, **options)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "doc_id string, path string")


def render_as(df: DataFrame, fmt: str, **options) -> DataFrame:
    return sinks.render(df, fmt, **options)


def convert(spark: SparkSession, source: str, folder: str, fmt: str, **options) -> DataFrame:
    """Files of a folder in another format, each at its path below the folder; clashes show before a file is parsed."""
    sinks.check_targets(sources.files_of(spark, source).select(F.col("path").alias("doc_id")), {"markdown": "md"}.get(fmt.lower(), fmt.lower()), source)
    return sinks.save(sources.read(spark, source, **options), folder, fmt, base=source, check=False)


def thumbnail(spark: SparkSession, *paths: str, width: int = previews.WIDTH, height: int = previews.HEIGHT) -> DataFrame:
    """(doc_id, thumbnail, data_uri) of files."""
    out = None
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        out = files if out is None else out.unionByName(files)
    return previews.thumbnails(out, most_width=width, most_height=height).withColumn("data_uri", previews.data_uri(F.col("thumbnail")))
