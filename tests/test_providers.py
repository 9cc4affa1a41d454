"""OCR, language models, thumbnails and streams, with stand-ins for what is outside."""

import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellum import model as m
from vellum import streaming
from vellum.operators import train
from vellum.plans import manager
from vellum.providers import llm, ocr, thumbnails


def scan(name, *pictures, text=0):
    return m.document("pdf", name, [m.section("page-1", [m.image("i", data=p.encode(), mime_type="image/png") for p in pictures] + [m.paragraph("x")] * text)], doc_id=name)


def test_ocr_replaces_sections(spark):
    df = m.documents(spark, [scan("a", "Bonjour tout le monde ici", "La société générale est grande"), scan("b", "Texte ignoré ici", text=3), scan("c")])
    engine = ocr.FunctionOcr(lambda data, lang: f"{data.decode()}\nWarning: x\n")
    out = {r.doc_id: r for r in ocr.ocr(df, engine, "auto", "fra").collect()}
    assert [e.text for e in out["a"].sections[0].elements] == ["Bonjour tout le monde ici", "La société générale est grande"]
    assert out["a"].sections[0].metadata == {"ocr_processed": "true"} and len(out["b"].sections[0].elements) == 4 and out["c"].sections[0].elements == []
    assert {r.doc_id: len(r.sections[0].elements) for r in ocr.ocr(df, engine, True, "fra").collect()}["b"] == 1
    assert ocr.ocr(df, engine, False) is df


def test_ocr_languages():
    engine = ocr.FunctionOcr(lambda data, lang: data.decode(), {"script": "Cyrillic", "confidence": 7.0})
    assert ocr.detect_language(engine, "Une phrase française à l'été déjà".encode()) == "fra"
    assert ocr.detect_language(engine, b"plain latin words of enough length") == "eng"
    assert ocr.detect_language(engine, b"short") == "rus"
    assert ocr.parse_script("Orientation in degrees: 90\nScript: Latin\nScript confidence: 3.2") == {"script": "Latin", "confidence": 3.2, "orientation": 90}


def test_commands():
    assert ocr.run_command(["echo", "bonjour"]) == (0, "bonjour\n") and ocr.run_command(["false"])[0] == 1
    start = time.time()
    assert ocr.run_command(["sleep", "10"], 0.5) == (-1, "") and time.time() - start < 5
    engine = ocr.CommandOcr("no-such-program")
    assert not engine.available() and engine.recognize(b"x") == "" and engine.command("i.png", "fra")[-2:] == ["-l", "fra"]
    assert ocr.filter_output("Corrupt JPEG data: x\n\ntexte\nWarning: y\n") == "texte"


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Model:
    def __init__(self, *answers):
        self.answers = list(answers)

    def ask(self, prompt, image=None, mime_type="image/png"):
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def test_llm(spark):
    page = 'Here: {"title": "T", "paragraphs": ["a", " "], "tables": [[["h"], [1]]], "confidence": 0.9}'
    assert llm.structure_page(Model("nothing", "still nothing", page), "x")["title"] == "T"
    with pytest.raises(ValueError):
        llm.structure_page(Model("nothing"), "x")
    assert [e["type"] for e in llm.page_elements(llm.read_page(page))] == ["paragraph", "paragraph", "table"]
    df = spark.createDataFrame([(1, "abc"), (2, " ")], "id long, text string")
    assert [r.text for r in llm.enhance(df, Model("done ")).orderBy("id").collect()] == ["done", ""]
    assert llm.provider_of({"provider": "claude"}) == "anthropic" and llm.provider_of({"provider": "x"}) == "openai"
    assert llm.parameters({"options": {"max_tokens": 5, "temperature": 0}}) == {"temperature": 0}
    assert not llm.enabled({}) and llm.enabled({"provider": "ollama"}) and llm.enabled({"api_key": "k"})
    for provider in ("anthropic", "gemini", "ollama", "openai"):
        url, _, body = llm.HttpClient({"provider": provider, "api_key": "k"}).request("p", b"img")
        assert url.startswith("http") and "aW1n" in str(body)


def test_structured_sections(spark):
    df = m.documents(spark, [scan("a", "Bonjour tout le monde ici")])
    read = ocr.ocr(df, ocr.FunctionOcr(lambda d, _: d.decode()), "auto", "fra")
    out = manager.structure_read_sections(read, Model('{"title": "T", "paragraphs": ["p"], "tables": [[["h"], ["1"]]], "confidence": 0.5}')).first()
    assert [(e.type, e.text) for e in out.sections[0].elements] == [("paragraph", "T"), ("paragraph", "p"), ("table", None)]
    assert out.sections[0].metadata["ocr_confidence"] == "0.5" and out.sections[0].elements[0].paragraph.style.heading_level == 1


def test_thumbnails(spark):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 255, (400, 600, 3)).astype(np.uint8)
    data = thumbnails.encode_png(pixels)
    assert (thumbnails.decode_png(data) == pixels).all()
    small = thumbnails.resize(data, 300, 300)
    assert (small["width"], small["height"], small["mime_type"]) == (300, 200, "image/png")
    assert abs(thumbnails.decode_png(small["data"]).astype(float).mean() - pixels.mean()) < 2
    assert thumbnails.resize(thumbnails.encode_png(pixels[:50, :50]))["width"] == 50 and thumbnails.resize(b"junk") is None
    assert thumbnails.fit(1000, 500) == (300, 150) and thumbnails.fit(10, 10) == (10, 10)
    assert thumbnails.usable(data) and not thumbnails.usable(thumbnails.encode_png(np.zeros((50, 50, 3), np.uint8)))
    assert thumbnails.largest_embedded(b"x" * 50 + data + b"y" * 20) == data
    flat = spark.createDataFrame([(1000.0, 500.0)], "w double, h double").select(thumbnails.fit_columns(F.col("w"), F.col("h")).alias("s")).first().s
    assert tuple(flat) == (300, 150)
    files = spark.createDataFrame([("a.csv", b"a,b\n1,2"), ("b.bin", b"?"), ("c.png", data)], "path string, content binary")
    got = {r.doc_id: r.thumbnail for r in thumbnails.thumbnails(files).collect()}
    assert got["a.csv"].width == 300 and got["b.bin"] is None and got["c.png"].height == 200


def test_streams(spark, tmp_path):
    folder, docs = tmp_path / "in", tmp_path / "docs"
    folder.mkdir()
    docs.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(f'{{"ts": "2026-01-01T00:0{i}:00", "text": "un deux {"trois " * i}"}}\n', encoding="utf-8")
        (docs / f"{i}.md").write_text(f"# T{i}", encoding="utf-8")
    schema = "ts timestamp, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run = streaming.keep_dictionary(stream, str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = train.dictionary(spark.read.schema(schema).json(str(folder)))
    assert sorted(map(tuple, streaming.dictionary_of(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, batch.collect()))
    for name, df, mode in (("words", streaming.dictionary(stream), "complete"), ("windows", streaming.windowed_words(stream, "ts"), "complete"), ("clean", streaming.cleaned(stream), "append"), ("parsed", streaming.parse_stream(spark, str(docs)), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.table("words").collect())) == sorted(map(tuple, batch.collect()))
    assert spark.table("windows").agg(F.sum("freq")).first()[0] == batch.agg(F.sum("freq")).first()[0]
    assert sorted(r.sections[0].elements[0].text for r in spark.table("parsed").collect()) == ["T0", "T1", "T2"]
