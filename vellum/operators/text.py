"""Cleaning and reading noisy text: all Column expressions, no Python on the executors.

Every function takes a text or line Column. Patterns that must know letters beyond ASCII use (?U); byte-wise ones use the
ASCII word border of `functions.BORDER`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import AFTER_WORD, BEFORE_WORD, BORDER, characters, letters, matches, once, replace_all, replace_each, trim, upper_first

# Letters that count as vowels and consonants.
VOWELS = "[aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿæœ]"
CONSONANTS = "[bcdfghjklmnpqrstvwxzçñß]"
NOISE_SYMBOLS = r"[|()\[\]<>{}+=&#@*^~\\]"

# Characters that speak for a language, in the order in which ties are settled.
LANGUAGE_SIGNS = (
    ("fra", "[çéèêëàâùûîïôœæ]"),
    ("deu", "[äöüß]"),
    ("spa", "[ñ¿¡]"),
    ("por", "[ãõ]"),
    ("pol", "[ąćęłńóśźż]"),
    ("ron", "[ăâîșț]"),
    ("nor", "[åæø]"),
)

# Script names to language codes.
SCRIPT_LANGUAGE = {
    "latin": "eng",
    "arabic": "ara",
    "cyrillic": "rus",
    "han": "chi_sim",
    "hangul": "kor",
    "japanese": "jpn",
    "devanagari": "hin",
    "greek": "ell",
    "hebrew": "heb",
    "thai": "tha",
    "georgian": "kat",
    "armenian": "hye",
}


def _count(c, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _distinct_share(c) -> Column:
    """Distinct characters among all."""
    return F.size(F.array_distinct(characters(c))) / F.greatest(F.length(c), F.lit(1))


def words(line) -> Column:
    return F.split(line, r"\s+", -1)


# Noise


def natural_word(word) -> Column:
    """Whether letters look like a word: vowels and consonants mixed, characters varied, none three times in a row."""
    low = F.lower(word)
    n, v, k = F.length(low), _count(low, VOWELS), _count(low, CONSONANTS)
    ratio = v / F.greatest(v + k, F.lit(1))
    good = ratio.between(0.10, 0.90) & ((n < 4) | (_distinct_share(low) >= 0.40)) & ~low.rlike(r"(.)\1{2,}")
    return F.when(n < 3, True).when(v + k == 0, False).when((v == 0) | (k == 0), n <= 3).otherwise(good)


def _long_words(ws) -> Column:
    """The letters of the words that have at least three."""
    return F.filter(F.transform(ws, letters), lambda w: F.length(w) >= 3)


def has_natural_words(line) -> Column:
    checked = _long_words(words(line))
    return F.when(F.size(checked) == 0, False).when(F.length(line) < 15, F.forall(checked, natural_word)).otherwise(F.exists(checked, natural_word))


def _noise(line, ls, ws) -> Column:
    """Rules in falling order of strength over a trimmed line, its letters and its words."""
    n_letters, n, n_words = F.length(ls), F.length(line), F.size(ws)
    dense = n_letters / F.greatest(F.length(F.regexp_replace(line, r"(?U)\s", "")), F.lit(1))
    variety = _distinct_share(F.lower(ls))
    dull = n_letters.between(5, 30) & ((variety < 0.40) | (F.lower(ls).rlike(r"(.)\1{2,}") & (variety < 0.50)))
    symbols = _count(line, NOISE_SYMBOLS)
    single = F.size(F.filter(ws, lambda w: F.length(w) == 1))
    checked = _long_words(ws)
    odd = F.size(F.filter(checked, lambda w: ~natural_word(w)))
    return (
        F.when((n_letters <= 2) | (n < 8) | (dense < 0.4), True)
        .when(dull | ~line.rlike(r"\p{L}{3,}"), True)
        .when(((symbols >= 2) & (n < 40)) | (symbols >= 3), True)
        .when((n < 30) & (n_words <= 5) & line.rlike(r"\p{L}[)\]]"), True)
        .when((n_words >= 4) & (single / F.greatest(n_words, F.lit(1)) > 0.4), True)
        .when((n < 25) & ~has_natural_words(line), True)
        .when((n_words >= 4) & (n < 50), (F.size(checked) >= 3) & (odd / F.greatest(F.size(checked), F.lit(1)) > 0.5))
        .otherwise(False)
    )


def is_noise_line(line) -> Column:
    """Whether a (trimmed, not blank) line is what OCR makes of logos, stamps and rules."""
    return _noise(line, letters(line), words(line))


def strip_garbled_prefix(line) -> Column:
    """Two to five short tokens before a capitalised word go if most of those with three letters are no words."""
    pattern = r"(?U)^((?:\S{1,8}\s+){2,5})(\p{Lu}\p{Ll}{3,})"
    checked = _long_words(words(trim(F.regexp_extract(line, pattern, 1))))
    odd = F.size(F.filter(checked, lambda w: ~natural_word(w)))
    garbled = line.rlike(pattern) & (F.size(checked) >= 2) & (odd / F.greatest(F.size(checked), F.lit(1)) >= 0.6)
    return F.when(garbled, F.regexp_replace(line, pattern, "$2")).otherwise(line)


# The patterns of artefacts.
#: Artefacts at the beginning of a line, in the order in which they are taken off.
LEADING = (
    r"(?U)^\d\s+(?=\p{L})",
    r"(?U)^\(\p{Lu}{1,2}\s+",
    r'(?U)^["«»]\p{L}{1,2}\s+',
    r"(?U)^[^\p{L}\d]{1,3}\s+",
    r"(?U)^\p{Ll}{1,3}\s+(?=\p{Lu})",
    r"(?U)^\p{Lu}\s+(?=\p{L})",
    r"(?U)^\p{Lu}{2}\s+(?=\p{Lu}\p{Ll})",
)
#: At the end: symbols with digits or punctuation after them, then a lone letter or digit.
TRAILING = (r'(?U)\s*[|(\[<>)\]+=#&"]{1,2}\s*[\d\p{P}\s]{0,5}$', r"(?U)\s+(?:\p{L}{1,2}|\d)$")


def clean_line_edges(line) -> Column:
    for p in LEADING:
        line = F.regexp_replace(line, p, "")
    line = F.when(F.length(line) > 30, strip_garbled_prefix(line)).otherwise(line)
    for p in TRAILING:
        line = F.regexp_replace(line, p, "")
    return trim(line)


def clean_ocr_noise(text) -> Column:
    """Noise lines go, the edges of the others are cleaned, and three or more newlines become two."""
    rows = F.transform(F.split(text, "\n", -1), lambda x: F.struct(trim(x).alias("line")))
    rows = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), letters(r["line"]).alias("ls"), words(r["line"]).alias("ws")))
    kept = F.filter(rows, lambda r: (r["line"] == "") | ~_noise(r["line"], r["ls"], r["ws"]))
    clean = F.transform(kept, lambda r: F.when(r["line"] == "", "").otherwise(clean_line_edges(r["line"])))
    return trim(F.regexp_replace(F.array_join(clean, "\n"), "\n{3,}", "\n\n"))


def is_garbage_text(text) -> Column:
    """Text of five characters or more of which under 15 % lie in ASCII words or numbers of two characters or more."""
    readable = F.length(F.array_join(matches(text, "[a-zA-Z]{2,}"), "")) + F.length(F.array_join(matches(text, "[0-9]{2,}"), ""))
    return (F.length(text) >= 5) & (readable / F.greatest(F.length(text), F.lit(1)) < 0.15)


def collapse_letter_spacing(text) -> Column:
    """`D e v i s` becomes `Devis` where spaces are at least 0.6 of the other characters."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    others = F.length(text) - spaces
    spaced = (F.length(text) >= 5) & (others > 0) & (spaces >= 0.6 * others) & text.rlike(r"(?U)^\s?\S\s\S\s\S")
    squeezed = F.regexp_replace(F.regexp_replace(text, r"(?U)(\S) (?=\S)", "$1"), r"(?U)\s{2,}", " ")
    return F.when(spaced, trim(squeezed)).otherwise(text)


# Fixed value: the control characters that texts must not hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def strip_control(text) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), CONTROL, "")


# Language


def language_scores(text) -> Column:
    """Occurrences of each language's characters, in the order of LANGUAGE_SIGNS; one pass over the text leaves only those."""
    signs = F.regexp_replace(text, "[^" + "".join(p[1:-1] for _, p in LANGUAGE_SIGNS) + "]+", "")
    return once(signs, lambda x: F.array(*[_count(x, p) for _, p in LANGUAGE_SIGNS]))


def detect_language(text) -> Column:
    """The language whose characters occur most, the first of equals; eng without any or under ten characters."""
    names = F.array(*[F.lit(n) for n, _ in LANGUAGE_SIGNS])
    found = once(language_scores(text), lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))))
    return F.when(F.length(text) >= 10, F.coalesce(found, F.lit("eng"))).otherwise("eng")


def script_language(script) -> Column:
    return F.coalesce(*[F.when(F.lower(script) == k, F.lit(v)) for k, v in SCRIPT_LANGUAGE.items()], F.lit("eng"))


# Confusions of characters

# Ligatures at the beginning of a word, and a bar between letters.
GLOBAL_PATTERNS = (
    (r"(?U)\bﬁ", "fi"),
    (r"(?U)\bﬂ", "fl"),
    (r"(?U)\bﬀ", "ff"),
    (r"(?U)\bﬃ", "ffi"),
    (r"(?U)\bﬄ", "ffl"),
    (r"(?<=\p{L})\|(?=\p{L})", "l"),
)
# In tokens with more letters than digits; those with a digit only if there is one.
WORD_SUBSTITUTIONS = (
    ("0", "O"),
    ("1", "l"),
    ("rn", "m"),
    ("vv", "w"),
    ("cI", "d"),
    ("Iooking", "looking"),
    ("tbe", "the"),
)
# In tokens with more digits than letters.
DIGIT_SUBSTITUTIONS = (
    ("O", "0"),
    ("o", "0"),
    ("l", "1"),
    ("I", "1"),
    ("S", "5"),
    ("B", "8"),
    ("G", "6"),
)


def fix_confusions(text, word=WORD_SUBSTITUTIONS, digit=DIGIT_SUBSTITUTIONS, patterns=GLOBAL_PATTERNS) -> Column:
    """Characters that OCR takes for one another, token by token; an empty table stands for the usual one."""
    word, digit, patterns = tuple(word) or WORD_SUBSTITUTIONS, tuple(digit) or DIGIT_SUBSTITUTIONS, tuple(patterns) or GLOBAL_PATTERNS
    changed = text
    for p, r in patterns:
        changed = F.regexp_replace(changed, p, r)
    # one look for the characters that the usual patterns change, before any of them is searched
    text = F.when(text.rlike("[ﬁﬂﬀﬃﬄ|]"), changed).otherwise(text) if patterns == GLOBAL_PATTERNS else changed
    numeric = [x for x in word if any(c.isdigit() for c in x[0])]
    plain = [x for x in word if x not in numeric]

    def token(t):
        n_letters, n_digits = F.length(letters(t)), F.length(F.regexp_replace(t, "[^0-9]", ""))
        first = F.when(n_digits > n_letters, replace_all(t, digit)).when((n_letters > n_digits) & (n_digits > 0), replace_all(t, numeric)).otherwise(t)
        return F.when(n_letters >= 3, replace_all(first, plain)).otherwise(first)

    # only a token with a digit or with one of the plain strings can change; others stay in the gaps between matches
    may_change = "|".join(["[0-9]", *(re.escape(a) for a, _ in plain)])
    return once(text, lambda x: F.when(x.rlike(may_change), replace_each(x, rf"(?U)(?<!\S)(?=\S*?(?:{may_change}))\S+", token)).otherwise(x))


# Entities

#: The border before a digit or letter and the one after, which need to look to one side only.
B, AT, TO = BORDER, BEFORE_WORD, AFTER_WORD
DATE = rf"(?=[0-9]){AT}([0-9]{{1,2}})\s*[/\-.]\s*([0-9]{{1,2}})\s*[/\-.]\s*([0-9]{{2,4}}){TO}"


def normal_date(raw) -> Column:
    """d/m/y with two digits for day and month and 20 before a year of two digits; the calendar is not asked."""
    day, month, year = (F.regexp_extract(raw, DATE, k) for k in (1, 2, 3))
    return F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))


# The patterns of entities.
#: (name, type, pattern, normaliser or None), applied in this order, each to what the one before has made of the text.
ENTITY_RULES = (
    ("date_dmy_slash", "date", DATE, normal_date),
    ("phone_international", "phone", rf"(?:\+[0-9]{{1,3}}[\s\-]?)?\(?[0-9]{{2,4}}\)?[\s\-]?[0-9]{{2,3}}[\s\-]?[0-9]{{2,3}}[\s\-]?[0-9]{{2,4}}{TO}", lambda m: F.regexp_replace(m, r"\s+", " ")),
    ("email", "email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", None),
    ("url", "url", r"(?i)(?:https?://|www\.)[^\s<>\]]+", None),
    ("amount", "amount", rf"(?i)(?=[0-9]){AT}[0-9]{{1,3}}(?:[\s.,][0-9]{{3}})*(?:[,.][0-9]{{1,2}})?\s*(?:€|EUR|DA|USD|\$|£|MAD|DZD|TND){B}", None),
    ("iban", "iban", rf"(?=[A-Z]){AT}[A-Z]{{2}}[0-9]{{2}}[\s\-]?[0-9A-Z]{{4}}[\s\-]?[0-9A-Z]{{4}}[\s\-]?[0-9A-Z]{{4}}(?:[\s\-]?[0-9A-Z]{{1,4}}){{0,5}}{TO}", lambda m: F.upper(F.regexp_replace(m, r"[\s\-]", ""))),
    ("siret", "siret", rf"(?=[0-9]){AT}[0-9]{{3}}[\s\-]?[0-9]{{3}}[\s\-]?[0-9]{{3}}[\s\-]?[0-9]{{3}}[\s\-]?[0-9]{{2}}{TO}", lambda m: F.regexp_replace(m, r"[\s\-]", " ")),
    ("reference", "reference", r"(?iU)\b(?:R[ée]f|N°|Ref|Dossier)[\s.:]*[\w\-/]+", None),
    ("spaced_number", "number", rf"(?=[0-9]){AT}([0-9]{{1,3}}(?:\s[0-9]{{3}}){{1,4}}){TO}", None),
)


#: By kind of entity what a text must hold for its rule to find anything: a cheap look before the pattern is searched.
NEEDED = {
    "date": "[0-9]\\s*[/\\-.]\\s*[0-9]",
    "phone": "[0-9]{2}",
    "email": "@",
    "url": "(?i)://|www\\.",
    "amount": "(?i)[0-9]\\s*(?:€|EUR|DA|USD|\\$|£|MAD|DZD|TND)",
    "iban": "[A-Z]{2}[0-9]{2}",
    "siret": "[0-9]{3}[\\s\\-]?[0-9]{3}",
    "reference": "(?iu)R[ée]f|N°|Dossier",
    "number": "[0-9]\\s[0-9]{3}",
}


def found_by(text, kind: str, pattern: str) -> Column:
    """The matches of a rule's pattern; of the usual rules only where the text holds what they need."""
    usual = any(r[1] == kind and r[2] == pattern for r in ENTITY_RULES)
    return F.when(text.rlike(NEEDED[kind]), matches(text, pattern)).otherwise(F.array().cast("array<string>")) if usual and kind in NEEDED else matches(text, pattern)


def entities_of(text, kind: str, pattern: str, normal=None) -> Column:
    """What one rule finds, as struct<type, raw, value>."""
    return F.transform(found_by(text, kind, pattern), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("raw"), (normal(m) if normal else m).alias("value")))


def _entity(kind: str):
    return lambda raw, value: F.struct(F.lit(kind).alias("type"), raw.alias("raw"), value.alias("value"))


def with_entities(df, text_col: str = "text", rules=ENTITY_RULES, custom=(), into: str = "entities"):
    """df with the text rewritten by all rules in order and a column of the entities found.

    One projection for each rule, so that no rule's pattern runs inside the next one's expression.
    """
    df = df.withColumn(into, F.array().cast("array<struct<type:string,raw:string,value:string>>"))
    text = F.col(text_col)
    for _, kind, pattern, normal in (*rules, *custom):
        # each pattern is searched once; most texts have no match and pass as they are
        df = df.withColumn("_v_met", found_by(text, kind, pattern))
        values = F.transform("_v_met", normal) if normal else F.col("_v_met")
        found = F.zip_with("_v_met", values, _entity(kind))
        gaps, values = F.split(text, pattern, -1), F.concat(values, F.array(F.lit("")))
        new = F.when(F.size("_v_met") == 0, text).otherwise(F.array_join(F.zip_with(gaps, values, lambda g, x: F.concat(g, x)), ""))
        df = df.withColumns({into: F.concat(into, found)} | ({text_col: new} if normal else {})).drop("_v_met")
    return df


# Structure

LIST_ITEM = r"(?U)^(?:(?:\d{1,3}|[a-zA-Z])[.)\-]|[\-*•–])\s+.+$"


def heading_level(line, most: int = 60) -> Column:
    """2 or 3 for a line in capitals of at least two words and four letters, without numbers or `key: value`; else 0."""
    ls, n = letters(line), F.length(line)
    may = (F.length(ls) >= 4) & (n <= most) & ~line.rlike(r"(?U)\d{2,}") & ~line.rlike(r"(?U):\s+") & (F.upper(ls) == ls) & (F.size(words(trim(line))) >= 2)
    return F.when(may & (n <= 30), 2).when(may & (n <= 50), 3).otherwise(0)


def line_class(line, most: int = 60) -> Column:
    """blank, heading, list, separator or paragraph, for a trimmed line."""
    bare = F.regexp_replace(line, r"(?U)\s", "")
    return F.when(line == "", "blank").when(heading_level(line, most) > 0, "heading").when(line.rlike(LIST_ITEM), "list").when(bare.rlike(r"^[\-=_*]{3,}$"), "separator").otherwise("paragraph")


def title_case(text) -> Column:
    """Capitals to title case: the first word and words of over three letters begin with a capital."""
    ws = F.transform(F.split(F.lower(text), " ", -1), lambda w, i: F.when((i == 0) | (F.length(w) > 3), upper_first(w)).otherwise(w))
    return F.when(F.upper(letters(text)) == letters(text), F.array_join(ws, " ")).otherwise(text)


def structured(text, most: int = 60) -> Column:
    """The text as Markdown: headings, list items, rules and paragraphs, parted by blank lines.

    Linear in the lines: each line brings its own separator, a newline between two paragraph lines and a blank line elsewhere.
    """
    lines = F.transform(F.split(text, "\n", -1), trim)
    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), line_class(x, most).alias("kind"), heading_level(x, most).alias("level")))
    before = F.concat(F.array(F.lit("blank")), F.transform(rows, lambda r: r["kind"]))
    joined = F.zip_with(rows, before, lambda r, b: F.struct(r.alias("r"), b.alias("before")))

    def emit(z):
        r, before = z["r"], z["before"]
        body = F.when(r["kind"] == "heading", F.concat(F.repeat(F.lit("#"), r["level"]), F.lit(" "), title_case(r["line"]))).when(r["kind"] == "separator", "---").otherwise(r["line"])
        return F.concat(F.when((r["kind"] == "paragraph") & (before == "paragraph"), "\n").otherwise("\n\n"), body)

    shown = F.filter(joined, lambda z: z["r"].isNotNull() & (z["r"]["kind"] != "blank"))
    return F.regexp_replace(F.array_join(F.transform(shown, emit), ""), r"\A\n+", "")


def structure_blocks(df, id_col: str, text_col: str = "text", most: int = 60):
    """(id, block_ix, type, level, lines): consecutive paragraph lines are a block; list items are one even across blank lines."""
    from pyspark.sql import Window as W

    lines = df.select(id_col, F.posexplode(F.transform(F.split(text_col, "\n", -1), trim)).alias("line_ix", "line"))
    lines = lines.withColumn("type", line_class(F.col("line"), most)).withColumn("level", heading_level(F.col("line"), most))
    order = W.partitionBy(id_col).orderBy("line_ix")
    lines = lines.withColumn("before", F.lag("type").over(order)).where("type <> 'blank'").withColumn("shown", F.lag("type").over(order))
    new = F.when(F.col("type") == "paragraph", F.coalesce(F.col("before") != "paragraph", F.lit(True))).when(F.col("type") == "list", F.coalesce(F.col("shown") != "list", F.lit(True))).otherwise(True)
    lines = lines.withColumn("block_ix", F.sum(new.cast("long")).over(order) - 1)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"])
    out = lines.groupBy(id_col, "block_ix").agg(F.first("type").alias("type"), F.max("level").alias("level"), packed.alias("lines"))
    return out.withColumn("lines", F.when(F.col("type") == "separator", F.array().cast("array<string>")).otherwise(F.col("lines")))


def paragraphs(text) -> Column:
    """Parts between blank lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, "\n{2,}", -1), trim), lambda x: x != "")
