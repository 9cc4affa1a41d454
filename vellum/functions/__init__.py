"""Scalar functions: Column in, Column out, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming takes off (fixed): space, tab, newline, return, NUL, vertical tab.
TRIMMED = " \t\n\r\0\x0b"
WORD_CHARS = "[A-Za-z0-9_]"
#: A word border by ASCII rules, as byte-wise patterns have it (Java's \b counts letters beyond ASCII).
BORDER = f"(?:(?<!{WORD_CHARS})(?={WORD_CHARS})|(?<={WORD_CHARS})(?!{WORD_CHARS}))"
#: The same before and after a word character, where one side is known.
BEFORE_WORD, AFTER_WORD = f"(?<!{WORD_CHARS})", f"(?!{WORD_CHARS})"


def once(value, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim(c) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def letters(c) -> Column:
    """Only the letters."""
    return F.regexp_replace(c, r"[^\p{L}]", "")


def characters(c) -> Column:
    """The code points, as an array."""
    return F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0))


def matches(c, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def replace_each(c, pattern: str, fn) -> Column:
    """Each match of pattern replaced by fn(match): the gaps and the replaced matches, joined."""
    found = F.transform(matches(c, pattern), fn)
    gaps = F.split(c, pattern, -1)
    return F.array_join(F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def replace_all(c, pairs) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def as_bytes_text(c) -> Column:
    """UTF-8 bytes as Latin-1 characters, for byte-wise comparison."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def byte_distance(a, b) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(as_bytes_text(a), as_bytes_text(b))


def upper_first(c) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def match_case(original, suggestion) -> Column:
    """ALL CAPS, Capitalised or as it is, after the original."""
    return F.when(F.upper(original) == original, F.upper(suggestion)).when(original.rlike(r"^\p{Lu}"), upper_first(suggestion)).otherwise(suggestion)


def escape_html(c) -> Column:
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")])


def escape_xml(c) -> Column:
    return replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_pipes(c) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def column_index(ref) -> Column:
    """Zero-based column of a cell reference such as AB12."""
    return F.aggregate(characters(F.regexp_replace(F.upper(ref), "[^A-Z]", "")), F.lit(0).cast("long"), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def column_letters(index) -> Column:
    """Letters of a zero-based column; three letters cover every spreadsheet, seven cover any int."""
    n, digits = index.cast("long") + 1, []
    for _ in range(7):
        rest = F.pmod(n - 1, F.lit(26))
        digits.insert(0, F.when(n > 0, F.chr(rest + 65)).otherwise(""))
        n = F.when(n > 0, F.floor((n - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return F.concat(*digits)


def sheet_name(c) -> Column:
    """Characters a sheet's name may not have become _, and the first 31 bytes stay (whole characters)."""
    clean = F.regexp_replace(c, r"[\\/?*\[\]:]+", "_")
    return F.when(F.octet_length(clean) <= 31, clean).otherwise(_cut_bytes(clean, 31))


def _cut_bytes(c, most: int) -> Column:
    """The longest beginning of at most `most` UTF-8 bytes; at most `most` characters need a look."""
    head = characters(F.substring(c, 1, most))
    kept = F.aggregate(head, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct(F.when(a["n"] + F.octet_length(x) <= most, F.concat(a["s"], x)).otherwise(a["s"]).alias("s"), (a["n"] + F.octet_length(x)).alias("n")))
    return kept["s"]


def format_number(c) -> Column:
    """Integers without a point, other numbers with at most ten decimals and no zeros at the end."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", c), "0+$", ""), r"\.$", "")
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.format_string("%.0f", c)).otherwise(short)


def human_size(n) -> Column:
    """Bytes as o, Ko, Mo or Go with at most one decimal."""
    out = None
    for power, unit in ((3, "Go"), (2, "Mo"), (1, "Ko"), (0, "o")):
        value = F.regexp_replace(F.round(n / float(1024**power), 1).cast("string"), r"\.0$", "")
        text = F.concat(value, F.lit(f" {unit}"))
        out = F.when(n >= (1024**power if power else -1), text) if out is None else out.when(n >= (1024**power if power else -(1 << 62)), text)
    return out


def points(value) -> Column:
    """A CSS length in points: pt as it is, px by 0.75, em by 12, a bare number as it is; else null."""
    number = F.regexp_extract(value, r"^\s*(-?[0-9.]+)", 1)
    n = F.when(number != "", number.cast("double"))
    return F.when(F.lower(value).endswith("px"), n * 0.75).when(F.lower(value).endswith("em"), n * 12.0).otherwise(n)


def twips_to_points(c) -> Column:
    return c / 20.0


def emu_to_pixels(c) -> Column:
    return F.round(c / 9525.0).cast("int")


def half_points(c) -> Column:
    return c / 2.0


def color_rgb(hex_color) -> Column:
    """#rrggbb as three numbers from 0 to 1."""
    h = F.regexp_replace(hex_color, "^#", "")
    return F.array(*[F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("double") / 255 for k in range(3)])


def resolve_path(base, target) -> Column:
    """target beside the file base, with .. taken up."""
    start = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat(start, target)), "/")
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.array_append(acc, x)))
    return F.array_join(out, "/")


#: Average glyph widths in thousandths of the size (fixed values of the page writer).
AVERAGE_WIDTH = {
    "Helvetica": 550,
    "Helvetica-Bold": 580,
    "Helvetica-Oblique": 550,
    "Helvetica-BoldOblique": 580,
    "Times-Roman": 500,
    "Times-Bold": 530,
    "Times-Italic": 500,
    "Times-BoldItalic": 530,
    "Courier": 600,
    "Courier-Bold": 600,
    "Courier-Oblique": 600,
    "Courier-BoldOblique": 600,
}


def wrap(c, font: str, size: float, width: float) -> Column:
    """Greedy lines of at most width points by the font's average glyph."""
    per = AVERAGE_WIDTH.get(font, 550) * size / 1000
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc, word):
        longer = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        full = (F.length(longer) * per > width) & (acc["line"] != "")
        return F.struct(F.when(full, F.array_append(acc["lines"], acc["line"])).otherwise(acc["lines"]).alias("lines"), F.when(full, word).otherwise(longer).alias("line"))

    done = F.aggregate(F.split(c, " ", -1), start, step, lambda a: F.when(a["line"] != "", F.array_append(a["lines"], a["line"])).otherwise(a["lines"]))
    return F.when(F.size(done) == 0, F.array(F.lit(""))).otherwise(done)
