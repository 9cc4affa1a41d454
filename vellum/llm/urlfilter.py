"""Operator 3: URL rules as one bit-parallel wildcard automaton.

Every rule becomes glob patterns over the canonical URL (`host` + `path`). All patterns are packed into 64-bit words of
Shift-And masks: bit i of the state says that the first i symbols of some pattern match so far. One step moves all
patterns over one byte of *every* URL of the batch at once (numpy over the batch).

Glob symbols: `*` any run without `/`, `**` any run, `?` one byte but `/`, `[...]` is not special.

Cases: a null URL, or one without `://`, has an empty host and path and fits no rule; an empty table gives an empty
result; equal URLs get equal results; a URL may be of any length (memory is the URL bytes plus one state row each);
columns of the input other than the id and URL are not touched and may have any name. Of two rules of equal length the
one listed first wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, table

#: (verdict, rule as host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What decides where no rule fits: block on any of these globs, else allow. This is the method's own list, a parameter.
DEFAULT_BLOCK_GLOBS = ("*spam-farm.**", "*cheap-pills.**", "*casino*/**")


@dataclass(frozen=True)
class Automaton:
    """Masks of all patterns; `owner[k]` is the rule of pattern k, whose last bit is `last[k]`."""

    step: np.ndarray  # (256, words): bit i: symbol i of its pattern accepts the byte
    stay: np.ndarray  # (256, words): bit i: a wildcard run after symbol i accepts the byte
    start: np.ndarray  # (words,): the state before the first byte
    first: np.ndarray  # (words,): first bits, which a shift must not reach from the pattern below
    last: tuple
    owner: tuple


def globs_of(rule: str) -> tuple[str, str]:
    """A rule fits its host and all subdomains, and any path that starts with its path."""
    return f"{rule}**", f"*.{rule}**"


def compile_globs(patterns: list[tuple[int, str]]) -> Automaton:
    """patterns: (owner, glob). Bits of a pattern: one before its first symbol, then one after each."""
    bits: list[tuple] = []  # (pattern starts here, byte set of the symbol or None, byte set that stays)
    last, owner = [], []
    every, segment = np.ones(256, bool), np.ones(256, bool)
    segment[ord("/")] = False
    for own, glob in patterns:
        raw, i = glob.encode(), 0
        bits.append([True, None, np.zeros(256, bool)])
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                bits[-1][2] = every
                i += 2
            elif raw[i : i + 1] == b"*":
                bits[-1][2] = bits[-1][2] | segment
                i += 1
            else:
                one = segment.copy() if raw[i : i + 1] == b"?" else np.arange(256) == raw[i]
                bits.append([False, one, np.zeros(256, bool)])
                i += 1
        last.append(len(bits) - 1)
        owner.append(own)
    words = max(1, -(-len(bits) // 64))
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    first = np.zeros(words, np.uint64)
    for i, (begins, accepts, stays) in enumerate(bits):
        w, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
        if begins:
            first[w] |= bit
        else:
            step[accepts, w] |= bit
        stay[stays, w] |= bit
    return Automaton(step, stay, first.copy(), first, tuple(last), tuple(owner))


def simulate(auto: Automaton, urls: list[bytes]) -> np.ndarray:
    """(len(urls), patterns) booleans: which patterns match the whole URL."""
    n, words = len(urls), auto.start.size
    lengths = np.fromiter(map(len, urls), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(urls), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[order]
    down = lengths[order]
    state = np.repeat(auto.start[None, :], n, axis=0)
    one, top = np.uint64(1), np.uint64(63)
    active = n
    for pos in range(int(down[0]) if n else 0):
        while active and down[active - 1] <= pos:
            active -= 1
        s, byte = state[:active], data[begin[:active] + pos]
        moved = s << one
        if words > 1:
            moved[:, 1:] |= s[:, :-1] >> top
        state[:active] = (moved & auto.step[byte]) | (s & auto.stay[byte])
    found = np.zeros((n, len(auto.last)), bool)
    for k, bit in enumerate(auto.last):
        found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
    return found


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path) as the contract says."""
    if not url or (at := url.find(b"://")) < 0:
        return b"", b""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find(b"/")
    return (rest[:slash].lower(), rest[slash:]) if slash >= 0 else (rest.lower(), b"")


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, block_globs=DEFAULT_BLOCK_GLOBS) -> DataFrame:
    """id, host, path, rule, verdict for each row of df. No shuffle: the rules are constants of the task."""
    patterns = [(k, g) for k, (_, rule) in enumerate(rules) for g in globs_of(rule)] + [(-1, g) for g in block_globs]
    auto = compile_globs(patterns)
    best_first = sorted(range(len(rules)), key=lambda k: -len(rules[k][1]))
    owners = np.array(auto.owner)

    def run(batch: pa.RecordBatch) -> dict:
        ids, urls = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        parts = [split_url(u) for u in urls]
        found = simulate(auto, [h + p for h, p in parts])
        has_url = np.array([bool(h or p) for h, p in parts])
        rule_of = np.full(len(urls), -1)
        for k in reversed(best_first):
            rule_of[found[:, owners == k].any(axis=1) & has_url] = k
        blocked = found[:, owners == -1].any(axis=1) & has_url if len(block_globs) else np.zeros(len(urls), bool)
        return {
            "id": ids,
            "host": pa.array([h for h, _ in parts], pa.binary()).cast(pa.string()),
            "path": pa.array([p for _, p in parts], pa.binary()).cast(pa.string()),
            "rule": pa.array([rules[k][1] if k >= 0 else None for k in rule_of.tolist()], pa.string()),
            "verdict": pa.array([rules[k][0] if k >= 0 else "block" if b else "allow" for k, b in zip(rule_of.tolist(), blocked.tolist())], pa.string()),
        }

    kind = df.schema[id_col].dataType.simpleString()
    out = map_rows(df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url")), run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def op3_url_shift_and(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                       ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN strpos(host, 'spam-farm.') > 0 OR strpos(host, 'cheap-pills.') > 0
         OR (strpos(host, 'casino') > 0 AND strpos(path, '/') = 1) THEN 'block'
       ELSE 'allow' END AS verdict
FROM ruled
"""
