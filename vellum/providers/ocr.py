"""OCR of document images: a pluggable engine called once per image, its texts cleaned and put in place of the images.

Images are exploded to rows and dealt out evenly, since one document may hold thousands; the texts of a section come back
together by one shuffle of texts, not images.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..operators.text import LANGUAGE_SIGNS, SCRIPT_LANGUAGE, clean_ocr_noise, paragraphs

EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/tiff": "tiff", "image/bmp": "bmp"}


def filter_output(text: str) -> str:
    """The lines of an engine's output that are text."""
    return "\n".join(x for x in text.split("\n") if x.strip() and not x.startswith(("Corrupt JPEG data", "Warning:"))).strip()


def run_command(argv: list[str], timeout: float = 60.0) -> tuple[int, str]:
    """(exit code, standard output); a command that takes longer is ended and gives (-1, '')."""
    env = os.environ | {"OMP_THREAD_LIMIT": "1", "OMP_NUM_THREADS": "1"}
    process = subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
    try:
        out, _ = process.communicate(timeout=timeout)
        return process.returncode, out.decode("utf-8", "replace")
    except subprocess.TimeoutExpired:
        process.terminate()
        try:
            process.wait(0.01)
        except subprocess.TimeoutExpired:
            process.kill()
            process.wait()
        return -1, ""


class CommandOcr:
    """An OCR program that takes an image's path and prints text, as tesseract does."""

    def __init__(self, binary: str = "tesseract", options: tuple[str, ...] = (), timeout: float = 60.0):
        self.binary, self.options, self.timeout = binary, tuple(options), timeout

    def available(self) -> bool:
        return shutil.which(self.binary) is not None

    def command(self, image: str, language: str = "eng") -> list[str]:
        return [self.binary, image, "stdout", "-l", language, *self.options]

    def recognize(self, data: bytes, mime_type: str | None = None, language: str = "eng") -> str:
        """The text of an image; '' if the program fails, is missing or takes too long."""
        if not self.available():
            return ""
        with tempfile.NamedTemporaryFile(suffix="." + EXTENSIONS.get(mime_type or "", "png")) as f:
            f.write(data)
            f.flush()
            code, out = run_command(self.command(f.name, language), self.timeout)
        return filter_output(out) if code == 0 else ""

    def detect_script(self, data: bytes, mime_type: str | None = None) -> dict:
        """script, confidence and orientation, as far as the program tells."""
        if not self.available():
            return {}
        with tempfile.NamedTemporaryFile(suffix="." + EXTENSIONS.get(mime_type or "", "png")) as f:
            f.write(data)
            f.flush()
            code, out = run_command([self.binary, f.name, "-", "--psm", "0"], self.timeout)
        return parse_script(out) if code == 0 else {}


class FunctionOcr:
    """An engine made of a Python function of (bytes, language): for tests and for engines with an API."""

    def __init__(self, fn: Callable[[bytes, str], str], script: dict | None = None):
        self.fn, self.script = fn, script or {}

    def available(self) -> bool:
        return True

    def recognize(self, data: bytes, mime_type: str | None = None, language: str = "eng") -> str:
        return filter_output(self.fn(data, language))

    def detect_script(self, data: bytes, mime_type: str | None = None) -> dict:
        return self.script


def parse_script(text: str) -> dict:
    out: dict = {}
    for key, pattern, kind in (("script", r"(?im)^\s*Script:\s*(.+?)\s*$", str), ("confidence", r"(?i)Script confidence:\s*([\d.]+)", float), ("orientation", r"(?i)Orientation in degrees:\s*(\d+)", int)):
        found = re.search(pattern, text)
        if found:
            out[key] = kind(found[1])
    return out


def language_of(text: str) -> str:
    """As operators.text.detect_language, for one text."""
    scores = [len(re.findall(p, text)) for _, p in LANGUAGE_SIGNS]
    return LANGUAGE_SIGNS[scores.index(max(scores))][0] if len(text) >= 10 and max(scores) else "eng"


def detect_language(engine, data: bytes, mime_type: str | None = None) -> str:
    """By a sample read as English if it is long enough and looks Latin, else by script, else English."""
    sample = engine.recognize(data, mime_type, "eng")
    if len(sample) >= 20:
        found = language_of(sample)
        if found != "eng":
            return found
        all_letters = [c for c in sample if c.isalpha()]
        if all_letters and sum(bool(re.match("[a-zA-ZÀ-ÿ]", c)) for c in all_letters) / len(all_letters) > 0.6:
            return "eng"
    said = engine.detect_script(data, mime_type)
    return SCRIPT_LANGUAGE.get(said.get("script", "").lower(), "eng") if said.get("confidence", 0) >= 5 else "eng"


def sections_to_read(df: DataFrame, mode: bool | str = "auto", least_text_ratio: float = 0.1) -> DataFrame:
    """(doc_id, section_ix, elements) of sections for OCR: all with images (True), those with little text ('auto'), none (False)."""
    s = m.sections(df)
    if mode is False:
        return s.where("1 = 0")
    if mode == "auto":
        return s.where(m.needs_ocr(F.col("elements"), least_text_ratio))
    return s.where(F.exists("elements", lambda e: e["type"] == "image"))


def read_images(images: DataFrame, engine, language: str = "auto", batch_language: bool = False) -> DataFrame:
    """images(doc_id, section_ix, element_ix, mime_type, data) with `ocr_text` in place of data.

    language 'auto' is found for each image; with batch_language the first image of the table decides for all.
    """
    if language == "auto" and batch_language:
        first = images.orderBy("doc_id", "section_ix", "element_ix").select("data", "mime_type").first()
        language = detect_language(engine, bytes(first.data), first.mime_type) if first else "eng"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for mime, data in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                lang = detect_language(engine, data, mime) if language == "auto" else language
                texts.append(engine.recognize(data, mime, lang) if data else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts, pa.string())], names=["doc_id", "section_ix", "element_ix", "ocr_text"])

    cols = images.select("doc_id", F.col("section_ix").cast("int"), F.col("element_ix").cast("int"), "mime_type", "data")
    return cols.mapInArrow(run, "doc_id string, section_ix int, element_ix int, ocr_text string")


def ocr(df: DataFrame, engine, mode: bool | str = "auto", language: str = "auto", least_text_ratio: float = 0.1, pipeline=None, batch_language: bool = False) -> DataFrame:
    """Documents whose chosen sections hold the paragraphs read from their images, and `ocr_processed` in their metadata.

    pipeline: a function from a DataFrame with a `text` column to one with that text corrected (plans.pipeline).
    """
    if mode is False or not engine.available():
        return df
    images = sections_to_read(df, mode, least_text_ratio).select("doc_id", "section_ix", F.posexplode("elements").alias("element_ix", "e")).where("e.type = 'image' AND e.image.data IS NOT NULL")
    images = images.select("doc_id", "section_ix", "element_ix", "e.image.mime_type", "e.image.data").repartition("doc_id", "section_ix", "element_ix")
    texts = read_images(images, engine, language, batch_language)
    ordered = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("element_ix", "ocr_text"))), lambda x: x["ocr_text"]), lambda t: t != "")
    sections = texts.groupBy("doc_id", "section_ix").agg(F.array_join(ordered, "\n\n").alias("text"))
    sections = sections.withColumn("text", clean_ocr_noise(F.col("text")))
    if pipeline is not None:
        sections = pipeline(sections.withColumn("_key", F.concat_ws("\x01", "doc_id", F.col("section_ix").cast("string"))), "_key").drop("_key")
    run = lambda t: F.array(F.struct(t.alias("text"), F.lit(None).cast(m.TEXT_STYLE).alias("style")))
    made = F.transform(paragraphs(F.col("text")), lambda t: F.struct(F.lit("paragraph").alias("type"), t.alias("text"), F.struct(F.lit(None).cast(m.PARA_STYLE).alias("style"), run(t).alias("runs")).alias("paragraph"), F.lit(None).cast(m.TABLE).alias("table"), F.lit(None).cast(m.IMAGE).alias("image")))
    new = sections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_ix", made))).alias("_new"))
    out = df.join(new, "doc_id", "left")

    def renewed(s, i):
        found = F.try_element_at("_new", i)
        meta = F.map_concat(F.map_filter(s["metadata"], lambda k, _: k != "ocr_processed"), F.create_map(F.lit("ocr_processed"), F.lit("true")))
        return F.when(found.isNull(), s).otherwise(F.struct(s["name"].alias("name"), meta.alias("metadata"), found.alias("elements")))

    return out.withColumn("sections", F.when(F.col("_new").isNull(), F.col("sections")).otherwise(F.transform("sections", renewed))).select(*df.columns)
