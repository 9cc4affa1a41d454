"""Operator 9: quality rules from repetition coverage.

For several n-gram lengths a rolling hash over the words of a text marks the n-grams that occur twice or more, and the
characters of the words inside such n-grams are measured (each once), as are the characters of repeated lines. All is
numpy over a whole Arrow batch: the words of all texts lie in one array, a window never crosses a text, and its hash is
joined with the text's number so that only repeats inside one text count.

Cases: null is an empty text (no words: `base_failed`); texts of any length are taken whole; equal texts get equal
results; an empty table gives an empty result; other input columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, table, utf8_values

MIN_WORDS, BASE_N, BASE_REPEAT_PERCENT = 20, 8, 30
#: Largest share of a text's word characters inside repeated n-grams, by n, and inside lines that repeat an earlier one.
COVERAGE_LIMITS = {3: 0.50, 4: 0.45, 5: 0.32, 6: 0.31, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.28}
DUP_LINE_CHARS_LIMIT = 0.30
#: Largest share of symbols among word characters.
SYMBOL_LIMIT = 0.06
SYMBOLS = b"#*$%&|<>"
#: Words that one numpy pass takes at most, unless one text alone has more.
BLOCK_WORDS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the low bits of a sum are as good as the high ones."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (polynomial modulo 2**64), at the run's first word."""
    base = 0xD6E8FEB86659FD93
    out = np.zeros(max(0, hashes.size - n + 1), np.uint64)
    for i in range(n):
        out += hashes[i : i + out.size] * np.uint64(pow(base, n - i, 1 << 64))
    return _mix(out)


def repeated_words(hashes: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Booleans: the words inside n-word windows that their text has twice or more, the first included."""
    grams = rolling(hashes, n)
    mask = np.zeros(hashes.size, bool)
    if not grams.size:
        return mask
    inside = text_of[: grams.size] == text_of[n - 1 :]
    at = np.flatnonzero(inside)
    keys = grams[at] ^ _mix(text_of[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(keys.size, bool)
    twice[1:] |= same
    twice[:-1] |= same
    begins = at[order[twice]]
    if begins.size:
        delta = np.zeros(hashes.size + 1, np.int64)
        np.add.at(delta, begins, 1)
        np.add.at(delta, begins + n, -1)
        mask = np.cumsum(delta[:-1]) > 0
    return mask


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the words of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All measures of a block of texts."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    words = [w for ws in split for w in ws]
    del split
    hashes = _mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    text_of = np.repeat(np.arange(len(texts)), counts)
    data = np.frombuffer(b" ".join(words), np.uint8)
    # characters of each word: bytes that do not continue a code point
    starts = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & (data != 0x20), dtype=np.int64)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths + 1) - lengths - 1
    chars = starts[begin + lengths] - starts[begin] if words else np.zeros(0, np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data], dtype=np.int64)])
    edges = np.concatenate([begin, [data.size]])
    out = {"n_words": counts, "word_chars": _per_text(chars, bounds), "n_symbols": symbols[edges[bounds[1:]]] - symbols[edges[bounds[:-1]]]}
    dup_lines, dup_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            seen: set[bytes] = set()
            for line in t.split(b"\n"):
                if line in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += sum(len(w.decode()) for w in line.split())
                elif line.strip():
                    seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars}
    for n in sorted({*COVERAGE_LIMITS, BASE_N}):
        mask = repeated_words(hashes, text_of, n)
        if n == BASE_N:
            out["n_repeat_words"] = _per_text(mask, bounds)
        out[f"chars_{n}"] = _per_text(np.where(mask, chars, 0), bounds)
    return out


def judge(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    good = (m["dup_line_chars"] <= DUP_LINE_CHARS_LIMIT * m["word_chars"]) & (m["n_symbols"] <= SYMBOL_LIMIT * m["word_chars"])
    for n, limit in COVERAGE_LIMITS.items():
        good &= m[f"chars_{n}"] <= limit * m["word_chars"]
    return failed, ~failed & good


def blocks(texts: list[bytes]):
    """Slices of texts with about BLOCK_WORDS words."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= BLOCK_WORDS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base measures, the coverage of repeated n-grams and lines, base_failed and kept."""
    limits = sorted(COVERAGE_LIMITS)

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8_values(batch.column(1))
        parts = [measure(texts[a:b]) for a, b in blocks(texts)]
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed, kept = judge(m)
        coverage = {f"coverage_{n}": m[f"chars_{n}"] / np.maximum(1, m["word_chars"]) for n in limits}
        return {"id": batch.column(0), "n_words": m["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"], "n_dup_lines": m["n_dup_lines"], "n_repeat_words": m["n_repeat_words"], "base_failed": failed, "kept": kept, "dup_line_chars": m["dup_line_chars"]} | coverage

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"coverage_{n} double" for n in limits)
    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, ddl).withColumnRenamed("id", id_col)


def op9_repetition_rules(spark, sf_dir) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same in DuckDB SQL: every n-gram as a row, which only small tables bear."""
    limits = sorted(COVERAGE_LIMITS)
    lengths = ", ".join(map(str, limits))
    split = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    bare = r"regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')"
    symbols = "[" + SYMBOLS.decode() + "]"
    coverage = ",\n  ".join(f"coalesce(max(c.chars) FILTER (c.n = {n}), 0) / greatest(1, any_value(m.word_chars))::DOUBLE AS coverage_{n}" for n in limits)
    good = " AND ".join(f"coalesce(max(c.chars) FILTER (c.n = {n}), 0) <= {x} * any_value(m.word_chars)" for n, x in COVERAGE_LIMITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {split} AS ws FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT unnest([{lengths}]) AS n) WHERE len(ws) >= n)),
twice AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM g) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM twice),
c AS (SELECT covered.doc_id, n, count(*) AS words, sum(length(ws[j])) AS chars FROM covered JOIN d ON d.doc_id = covered.doc_id GROUP BY ALL),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
      FROM (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)))),
dup AS (SELECT doc_id, count(*) AS lines, sum(length({bare})) AS chars FROM l WHERE k > 1 AND {bare} <> '' GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '{symbols}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id),
r AS (SELECT m.doc_id, any_value(m.n_words) AS n_words, any_value(m.word_chars) AS word_chars, any_value(m.n_symbols) AS n_symbols, any_value(m.n_dup_lines) AS n_dup_lines,
        any_value(m.dup_line_chars) AS dup_line_chars, CAST(coalesce(max(c.words) FILTER (c.n = {BASE_N}), 0) AS BIGINT) AS n_repeat_words,
        {good} AS good,
  {coverage}
      FROM m LEFT JOIN c ON c.doc_id = m.doc_id GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words) AND good AND dup_line_chars <= {DUP_LINE_CHARS_LIMIT} * word_chars AND n_symbols <= {SYMBOL_LIMIT} * word_chars AS kept,
  dup_line_chars, {", ".join(f"coverage_{n}" for n in limits)} FROM r"""
