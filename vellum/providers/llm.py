"""Language models: correcting a text and structuring a page, by a client that goes to the executors."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as m

PAGE = "struct<title:string,paragraphs:array<string>,tables:array<array<array<string>>>,confidence:double>"
RETRIES = 2
SYSTEM = "You turn scanned or noisy document pages into clean, faithful text. Keep the language and the order of the page and add nothing."

#: Names of providers; any other name is the last.
PROVIDERS = {"anthropic": "anthropic", "claude": "anthropic", "gemini": "gemini", "ollama": "ollama", "openai": "openai"}


def enabled(config: dict) -> bool:
    """Without a key nothing is called, unless the provider runs locally."""
    return bool(config.get("enabled", True)) and (bool(config.get("api_key")) or provider_of(config) == "ollama")


def provider_of(config: dict) -> str:
    return PROVIDERS.get(config.get("provider", "openai"), "openai")


def parameters(config: dict) -> dict:
    """Options for the model, without max_tokens, which is a setting of its own."""
    return {k: v for k, v in (config.get("options") or {}).items() if k != "max_tokens"}


class HttpClient:
    """A chat endpoint over HTTP. `ask` takes a prompt and perhaps an image and gives the answer's text."""

    def __init__(self, config: dict):
        self.config, self.provider = config, provider_of(config)

    def request(self, prompt: str, image: bytes | None = None, mime_type: str = "image/png") -> tuple[str, dict, dict]:
        """(url, headers, body)"""
        c, picture = self.config, base64.b64encode(image).decode() if image else None
        model, key, options = c.get("model", "gpt-4o-mini"), c.get("api_key", ""), parameters(c)
        if self.provider == "anthropic":
            content = [{"type": "image", "source": {"type": "base64", "media_type": mime_type, "data": picture}}] if picture else []
            body = {"model": model, "max_tokens": int((c.get("options") or {}).get("max_tokens", 4096)), "system": SYSTEM, "messages": [{"role": "user", "content": [*content, {"type": "text", "text": prompt}]}]}
            return c.get("base_url") or "https://api.anthropic.com/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, body | options
        if self.provider == "gemini":
            parts = [{"inline_data": {"mime_type": mime_type, "data": picture}}] if picture else []
            url = (c.get("base_url") or "https://generativelanguage.googleapis.com/v1beta") + f"/models/{model}:generateContent"
            return url, {"x-goog-api-key": key}, {"system_instruction": {"parts": [{"text": SYSTEM}]}, "contents": [{"parts": [*parts, {"text": prompt}]}], "generationConfig": options}
        if self.provider == "ollama":
            message = {"role": "user", "content": prompt} | ({"images": [picture]} if picture else {})
            return (c.get("base_url") or "http://localhost:11434/api") + "/chat", {}, {"model": model, "stream": False, "messages": [{"role": "system", "content": SYSTEM}, message], "options": options}
        content = [{"type": "text", "text": prompt}] + ([{"type": "image_url", "image_url": {"url": f"data:{mime_type};base64,{picture}"}}] if picture else [])
        return (c.get("base_url") or "https://api.openai.com/v1") + "/chat/completions", {"Authorization": f"Bearer {key}"}, {"model": model, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": content}]} | options

    def ask(self, prompt: str, image: bytes | None = None, mime_type: str = "image/png") -> str:
        url, headers, body = self.request(prompt, image, mime_type)
        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(call, timeout=self.config.get("timeout", 120)) as r:  # noqa: S310 - the configured endpoint
            got = json.load(r)
        if self.provider == "anthropic":
            return "".join(x.get("text", "") for x in got["content"])
        if self.provider == "gemini":
            return "".join(x.get("text", "") for x in got["candidates"][0]["content"]["parts"])
        return got["message"]["content"] if self.provider == "ollama" else got["choices"][0]["message"]["content"]


def enhance_text(client, text: str) -> str:
    if not (text or "").strip():
        return ""
    return client.ask(f"This text comes from OCR. Correct its errors and its layout. Answer with the corrected text alone.\n\n---\n{text}\n---").strip()


def read_page(answer: str) -> dict:
    """The page's content from an answer that holds a JSON object; ValueError if it holds none."""
    start, end = answer.find("{"), answer.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no object in the answer")
    got = json.loads(answer[start : end + 1])
    text = lambda x: "" if x is None else str(x)
    return {"title": text(got.get("title")), "paragraphs": [text(p) for p in got.get("paragraphs") or []], "tables": [[[text(c) for c in row] for row in t] for t in got.get("tables") or []], "confidence": float(got.get("confidence") or 0.0)}


def structure_page(client, text: str, image: bytes | None = None, mime_type: str = "image/png", retries: int = RETRIES) -> dict:
    prompt = "Give the content of this page as one JSON object with the keys title (string), paragraphs (array of strings, corrected), tables (array of arrays of rows) and confidence (0 to 1)."
    if (text or "").strip():
        prompt += f"\nOCR read this text on it:\n---\n{text}\n---"
    for left in range(retries, -1, -1):
        try:
            return read_page(client.ask(prompt, image, mime_type))
        except ValueError:
            if not left:
                raise
    raise AssertionError


def enhance(df: DataFrame, client, text_col: str = "text", into: str | None = None) -> DataFrame:
    """df with the text corrected by the client, a call for each row."""
    into = into or text_col
    names = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([enhance_text(client, t) for t in batch.column(batch.schema.get_field_index("_llm")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), made], names=[*names, into])

    ddl = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), f"`{into}` string"])
    return df.select(*names, F.col(text_col).alias("_llm")).mapInArrow(run, ddl).select(*(df.columns if into in df.columns else [*df.columns, into]))


def structure(pages: DataFrame, client, key_cols: list[str], text_col: str = "text", image_col: str | None = None) -> DataFrame:
    """(keys, page) with page as struct of title, paragraphs, tables and confidence."""
    schema = pa.schema([("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(key_cols)
            made = [structure_page(client, t, i) for t, i in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.struct(schema))], names=[*key_cols, "page"])

    ddl = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key_cols) + f", page {PAGE}"
    image = F.col(image_col) if image_col else F.lit(None).cast("binary")
    return pages.select(*key_cols, F.col(text_col).cast("string").alias("_t"), image.alias("_i")).mapInArrow(run, ddl)


def page_elements(page: dict) -> list[dict]:
    """The elements of a structured page: a heading for the title, paragraphs, and tables whose first row is the header."""
    out = [m.heading(page["title"], 1)] if page.get("title") else []
    out += [m.paragraph(p) for p in page.get("paragraphs") or [] if p.strip()]
    return out + [m.table([(k == 0, list(r)) for k, r in enumerate(t)]) for t in page.get("tables") or [] if t]
