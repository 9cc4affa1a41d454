"""Operator 4: exact token counts at every prefix by dynamic programming.

For byte-level BPE the last token of a prefix's encoding is the only token t that ends the prefix and may follow the last
token of the prefix without t. So one pass from left to right gives, for every prefix, its last token and its count:
count[i] = count[i - len(t)] + 1. Tokens never cross the pieces that the pre-tokenizer cuts, so the pass runs once per
distinct piece and its counts are kept in the worker; a text's prefix counts are the running sum of its pieces' count
*differences*. From these, truncation to a budget and the count of any prefix are look-ups. The query stores them with
each text, and `fit_budgets` and `tokens_of_prefixes` answer from what is stored.

A piece here is a pre-tokenizer piece, but a run of white space of two or more is joined with the piece after it, since
cutting a text inside such a run changes how the run is cut; so counts hold for the prefix encoded on its own.

Special strings inside a text are one token each, as the library's default has it. A prefix that ends inside a special string
is counted as ordinary text.

Cases: null is an empty text (no tokens); texts and pieces of any length are whole; equal texts get equal counts; an
empty table gives an empty result; other input columns are not touched.
"""

from __future__ import annotations

import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table, worker_cache

#: The byte-level pre-tokenizer's pattern (fixed), but with each longer run of white space joined with the piece after it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s{2,}(?:(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
RUN = r"\s{2,}"
LIMIT = 1024
#: Pieces that a worker keeps; older ones go first.
KEPT_PIECES = 600_000


class PrefixCounter:
    """Prefix counts for a byte-level BPE file of the `tokenizers` library, given as its JSON text."""

    def __init__(self, file: str):
        spec = json.loads(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE is known here")
        byte_of = self._bytes_of_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        singles = [bytes([b]) for b in range(256)]
        #: Token numbers are ranks: 256 single bytes, then the merges in order.
        self.rank = {s: i for i, s in enumerate(singles)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = (bytes(byte_of[c] for c in s) for s in (a, b))
            r = len(self.halves)
            p = self.rank[x], self.rank[y]
            self.halves.append(p)
            self.pair.setdefault(p, r)
            self.rank.setdefault(x + y, r)
        #: All tokens that end at a byte, found in one pass; bytes as Latin-1 characters.
        self.tokens = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.tokens.add_word(token.decode("latin-1"), (len(token), r))
        self.tokens.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] or t["content"]]
        self.pieces, self.run_of_space = regex.compile(PIECES), regex.compile(RUN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _bytes_of_letters() -> dict[str, int]:
        """The byte-level alphabet: printable Latin-1 letters stand for themselves, the other bytes follow from U+0100."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        out = {chr(b): b for b in plain}
        for k, b in enumerate(b for b in range(256) if b not in set(plain)):
            out[chr(256 + k)] = b
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens: no merge across the border comes before theirs."""
        pair, halves, limit = self.pair, self.halves, 1 << 60
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = halves[left][1]
                if left == limit:
                    limit = right + 1
                    right = halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = halves[right][0]
                if right + 1 == limit:
                    limit = left
                    left = halves[left][1]
                    if left == limit:
                        return True

    def run(self, piece: bytes) -> list[int]:
        """Tokens of each byte prefix of one pre-tokenizer piece, from the empty one on."""
        may = self.may_follow
        count, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        for end, (size, token) in self.tokens.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                at = end - size
                if not at or may(last[at], token):
                    count[end], last[end] = count[at] + 1, token
        return count

    def of_piece(self, piece: str) -> bytes:
        """Differences of the counts at the piece's characters, as 16-bit numbers."""
        run = self.run_of_space.match(piece) if piece[:1].isspace() else None
        if run:
            space, rest = piece[: run.end()], piece[run.end() :]
            counts = self._at_characters(space)
            if rest:  # the run without its last character, which goes with the rest if it is a space
                base = counts[-2]
                if space[-1] == " ":
                    counts += [base + c for c in self._at_characters(" " + rest)[1:]]
                else:
                    base += self._at_characters(space[-1])[0]
                    counts += [base + c for c in self._at_characters(rest)]
        else:
            counts = self._at_characters(piece)
        return array("h", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def _at_characters(self, piece: str) -> list[int]:
        """Counts at the characters of one piece of the library's cut."""
        raw = piece.encode()
        counts = self.run(raw)
        if len(raw) == len(piece):
            return counts[1:]
        at, out = 0, []
        for c in piece:
            at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(counts[at])
        return out

    def _ordinary(self, text: str) -> list[bytes]:
        out, new, old = [], self.new, self.old
        for piece in self.pieces.findall(text):
            d = new.get(piece)
            if d is None:
                d = old.get(piece)
                if d is None:
                    d = self.of_piece(piece)
                if len(piece) <= 64:
                    new[piece] = d
                    if len(new) > KEPT_PIECES // 2:
                        self.old, self.new = new, {}
                        new, old = self.new, self.old
            out.append(d)
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of every prefix of text that ends at a character, from the empty one on."""
        parts = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
        deltas: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2 == 0:
                deltas += self._ordinary(part)
            else:  # ordinary counts inside a special string, where it is one text with the piece before it; at its end one token
                tail = (self.pieces.findall(parts[k - 1]) or [""])[-1]
                joined = np.cumsum(np.frombuffer(b"".join(self._ordinary(tail + part)), np.int16), dtype=np.int64)
                before = int(np.frombuffer(b"".join(self._ordinary(tail)), np.int16).sum())
                inner = np.append(joined[len(tail) : -1] - before, 1)
                deltas.append(array("h", np.diff(inner, prepend=0).tolist()).tobytes())  # raises where 16 bits don't hold a difference
        return np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(deltas), np.int16), dtype=np.int64)])


def truncate(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def tokens_between(counts: np.ndarray, start: int, end: int) -> int:
    """Tokens that the text grows by from one prefix to another."""
    return int(counts[end] - counts[start])


def pack_counts(counts: np.ndarray) -> bytes:
    """Prefix counts as a byte that tells the width and the differences from prefix to prefix, mostly a byte each."""
    steps = np.diff(counts)
    width = next(w for w in (1, 2, 4, 8) if not steps.size or np.abs(steps).max() < 1 << 8 * w - 1)
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpack_counts(stored: bytes) -> np.ndarray:
    """The token count of every prefix, from the empty one on."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64)])


def counter_of(file: str) -> PrefixCounter:
    """The counter of a tokenizer file, made once in each worker."""
    cache = worker_cache()
    if cache.get("counter_file") != file:
        cache["counter"], cache["counter_file"] = PrefixCounter(file), file
    return cache["counter"]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def count_tokens(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, store_prefixes: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within limit) and prefix_steps for each row.

    prefix_steps holds the count at every character prefix (`unpack_counts`), about as large as the text; the answers below
    come from it alone. file is the tokenizer's JSON, a constant of about 1.5 MB that goes out once as a broadcast variable.
    """
    shipped = df.sparkSession.sparkContext.broadcast(file)

    def run(batch: pa.RecordBatch) -> dict:
        counter = counter_of(shipped.value)
        n_bytes, n_tokens, fits, stored = [], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            counts = counter.prefix_counts(text)
            n_bytes.append(len(text.encode()))
            n_tokens.append(int(counts[-1]))
            fits.append(len(text) if counts[-1] <= limit and counts.max() <= limit else truncate(counts, limit))
            if store_prefixes:
                stored.append(pack_counts(counts))
        out = {"id": batch.column(0), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens], "fit_chars": fits}
        return out | ({"prefix_steps": pa.array(stored, pa.binary())} if store_prefixes else {})

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_steps binary" * store_prefixes
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, ddl).withColumnRenamed("id", id_col)


def fit_budgets(counted: DataFrame, budget_col: str, id_col: str = "doc_id") -> DataFrame:
    """id, budget and fit_chars (characters of the longest prefix of at most budget tokens), from stored prefix counts; nothing is encoded again."""

    def run(batch: pa.RecordBatch) -> dict:
        fits = [truncate(unpack_counts(steps), budget) if budget is not None else None for budget, steps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"id": batch.column(0), "budget": batch.column(1), "fit_chars": pa.array(fits, pa.int64())}

    kind = counted.schema[id_col].dataType.simpleString()
    return map_rows(counted.select(F.col(id_col).alias("id"), F.col(budget_col).cast("long").alias("budget"), "prefix_steps"), run, f"id {kind}, budget long, fit_chars long").withColumnRenamed("id", id_col)


def tokens_of_prefixes(counted: DataFrame, chars_col: str, id_col: str = "doc_id") -> DataFrame:
    """id, chars and tokens of the text's first chars characters (all of it, if it has fewer), from stored prefix counts."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for chars, steps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts = unpack_counts(steps)
            out.append(None if chars is None else int(counts[min(max(chars, 0), counts.size - 1)]))
        return {"id": batch.column(0), "chars": batch.column(1), "tokens": pa.array(out, pa.int64())}

    kind = counted.schema[id_col].dataType.simpleString()
    return map_rows(counted.select(F.col(id_col).alias("id"), F.col(chars_col).cast("long").alias("chars"), "prefix_steps"), run, f"id {kind}, chars long, tokens long").withColumnRenamed("id", id_col)


def op4_prefix_tokens(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
