"""Text operators against plain-Python twins written from their rules, row by row on the corpus and on hard cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum import functions as fn
from vellum.operators import text as ops
from vellum.plans.pipeline import from_config

HARD = [
    "", "   ", "ab", "|| || x", "OOOIOOOCOI", "1 Facture du mois", "(G Rapport annuel", "Bonjour tout le monde |", "xx yy zzzz qqqq Rapport de la société générale ici", "abc) de f", "a b c d e f", "Total 12 345,00 EUR\n\n\n\nFin du texte ici",
    "ﬁn de la ﬂotte", "m|eux", "modern tbe cIub vvord", "O12 l5O 1O0 h0use 1ist", "Le 3/4/21 et 12-11-2020, tel +33 6 12 34 56 78.", "FR76 3000 6000 0112 3456 7890 189 puis 123 456 789 123 45", "ecrire a jean.dupont+x@mail.example.fr ou www.site.fr/page",
    "Réf: ABC-123/4 et Dossier 77", "691 000 000 DA payes, 12,50 € dus", "TITRE DU DOCUMENT\n\nUn paragraphe\nsur deux lignes\n- un\n- deux\n\n- trois\n1. quatre\n-----\nFIN DU TEXTE ICI", "été 12 - 1/2/3 é1/2/2020é", "D e v i s   N °", "H e l l o w o r l d", "日本語のテキスト 2020 年", "ÉTÉ À LA PLAGE\ntexte",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:120]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()


def column(frame, expr):
    return [r.v for r in frame.select("doc_id", expr.alias("v")).orderBy("doc_id").collect()]


TRIM = " \t\n\r\0\x0b"
is_letter = lambda c: unicodedata.category(c).startswith("L")
only = lambda s: "".join(c for c in s if is_letter(c))
VOWELS, CONSONANTS = set("aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿæœ"), set("bcdfghjklmnpqrstvwxzçñß")


def natural(w):
    w = w.lower()
    if len(w) < 3:
        return True
    v, k = sum(c in VOWELS for c in w), sum(c in CONSONANTS for c in w)
    if v + k == 0:
        return False
    if not v or not k:
        return len(w) <= 3
    return 0.10 <= v / (v + k) <= 0.90 and not (len(w) >= 4 and len(set(w)) / len(w) < 0.40) and not re.search(r"(.)\1\1", w)


def noise(line):
    ls, words = only(line), re.split(r"[ \t\n\x0b\f\r]+", line)
    if len(ls) <= 2 or len(line) < 8 or len(ls) / max(1, len(re.sub(r"\s", "", line))) < 0.4:
        return True
    if 5 <= len(ls) <= 30:
        d = len(set(ls.lower())) / len(ls.lower())
        if d < 0.40 or (d < 0.50 and re.search(r"(.)\1\1", ls.lower())):
            return True
    run = best = 0
    for c in line:
        run = run + 1 if is_letter(c) else 0
        best = max(best, run)
    symbols = sum(c in "|()[]<>{}+=&#@*^~\\" for c in line)
    if best < 3 or (symbols >= 2 and len(line) < 40) or symbols >= 3:
        return True
    if len(line) < 30 and len(words) <= 5 and any(is_letter(a) and b in ")]" for a, b in zip(line, line[1:])):
        return True
    if len(words) >= 4 and sum(len(w) == 1 for w in words) / len(words) > 0.4:
        return True
    checked = [only(w) for w in words if len(only(w)) >= 3]
    good = [natural(w) for w in checked]
    if len(line) < 25 and (not checked or not (all(good) if len(line) < 15 else any(good))):
        return True
    return len(words) >= 4 and len(line) < 50 and len(checked) >= 3 and good.count(False) / len(checked) > 0.5


def test_noise(spark, frame, texts):
    lines = sorted({x.strip(TRIM) for t in texts for x in t.split("\n") if x.strip(TRIM)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = column(df, ops.is_noise_line(F.col("text")))
    wrong = [(x, g) for x, g in zip(lines, got) if g != noise(x)]
    assert not wrong, wrong[:3]
    cleaned = column(frame, ops.clean_ocr_noise(F.col("text")))
    for t, c in zip(texts, cleaned):
        kept = [x for x in t.split("\n") if x.strip(TRIM) and not noise(x.strip(TRIM))]
        assert len([x for x in c.split("\n") if x]) <= len(kept) and "\n\n\n" not in c and c == c.strip(TRIM)


def test_edges(spark):
    cases = {"1 Facture": "Facture", "(G Rapport": "Rapport", "«a Bon": "Bon", "-- Texte": "Texte", "ab Rapport": "Rapport", "A la": "la", "AB Texte": "Texte", "Texte |": "Texte", "Texte (12.": "Texte", "Texte x": "Texte", "Texte 5": "Texte", "qqqq xxxx zzzz Rapport annuel de la société ici": "Rapport annuel de la société ici"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert column(df, ops.clean_line_edges(F.col("text"))) == list(cases.values())


def confusions(t):
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = re.sub(rf"\b{a}", b, t)
    t = "".join("l" if c == "|" and 0 < i < len(t) - 1 and is_letter(t[i - 1]) and is_letter(t[i + 1]) else c for i, c in enumerate(t))

    def token(m):
        w = m[0]
        n, d = len(only(w)), sum(c in "0123456789" for c in w)
        if d > n:
            for a, b in ops.DIGIT_SUBSTITUTIONS:
                w = w.replace(a, b)
        elif n > d > 0:
            w = w.replace("0", "O").replace("1", "l")
        if n >= 3:
            for a, b in ops.WORD_SUBSTITUTIONS[2:]:
                w = w.replace(a, b)
        return w

    return re.sub(r"\S+", token, t)


def test_confusions(frame, texts):
    got = column(frame, ops.fix_confusions(F.col("text")))
    assert got == [confusions(t) for t in texts]


A = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
W = r"[ \t\n\x0b\f\r]"


def entities(t):
    found = []

    def rule(kind, pattern, normal=lambda m: m[0], flags=0):
        nonlocal t

        def one(m):
            found.append((kind, m[0], normal(m)))
            return normal(m)

        t = re.sub(pattern.replace(r"\b", A).replace(r"\s", W).replace(r"\d", "[0-9]"), one, t, flags=flags)

    rule("date", r"\b(\d{1,2})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{2,4})\b", lambda m: f"{int(m[1]):02d}/{int(m[2]):02d}/{'20' + m[3] if len(m[3]) == 2 else m[3]}")
    sep = "[ \t\n\x0b\f\r-]?"
    rule("phone", rf"(?:\+\d{{1,3}}{sep})?\(?\d{{2,4}}\)?{sep}\d{{2,3}}{sep}\d{{2,3}}{sep}\d{{2,4}}\b", lambda m: re.sub(W + "+", " ", m[0]))
    rule("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    rule("url", "(?:https?://|www\\.)[^ \t\n\x0b\f\r<>\\]]+", flags=re.I | re.A)
    rule("amount", "\\b\\d{1,3}(?:[ \t\n\x0b\f\r.,]\\d{3})*(?:[,.]\\d{1,2})?\\s*(?:€|EUR|DA|USD|\\$|£|MAD|DZD|TND)\\b", flags=re.I)
    rule("iban", rf"\b[A-Z]{{2}}\d{{2}}{sep}[0-9A-Z]{{4}}{sep}[0-9A-Z]{{4}}{sep}[0-9A-Z]{{4}}(?:{sep}[0-9A-Z]{{1,4}}){{0,5}}\b", lambda m: re.sub("[ \t\n\x0b\f\r-]", "", m[0]).upper())
    rule("siret", rf"\b\d{{3}}{sep}\d{{3}}{sep}\d{{3}}{sep}\d{{3}}{sep}\d{{2}}\b", lambda m: re.sub("[ \t\n\x0b\f\r-]", " ", m[0]))
    t2 = t
    t = re.sub(r"\b(?:R[ée]f|N°|Ref|Dossier)[\s.:]*[\w\-/]+", lambda m: found.append(("reference", m[0], m[0])) or m[0], t2, flags=re.I)
    rule("number", r"\b(\d{1,3}(?:\s\d{3}){1,4})\b")
    return t, found


def test_entities(frame, texts):
    out = ops.with_entities(frame).orderBy("doc_id").collect()
    for t, r in zip(texts, out):
        want, found = entities(t)
        assert r.text == want and [tuple(e) for e in r.entities] == found, t


def blocks(t):
    out, para = [], False
    for line in t.split("\n"):
        x = line.strip(TRIM)
        ls = only(x)
        if not x:
            para = False
            continue
        caps = len(ls) >= 4 and len(x) <= 60 and not re.search(r"\d{2,}", x) and not re.search(r":\s+", x) and ls.upper() == ls and len(x.split()) >= 2
        if caps and len(x) <= 50:
            out.append(("heading", [x]))
            para = False
        elif re.match(r"(?:(?:\d{1,3}|[a-zA-Z])[.)-]|[-*•–])\s+.+$", x):
            if out and out[-1][0] == "list":
                out[-1][1].append(x)
            else:
                out.append(("list", [x]))
            para = False
        elif re.fullmatch(r"[-=_*]{3,}", re.sub(r"\s", "", x)):
            out.append(("separator", []))
            para = False
        elif para:
            out[-1][1].append(x)
        else:
            out.append(("paragraph", [x]))
            para = True
    return out


def title(t):
    ws = t.lower().split(" ")
    return " ".join(w[:1].upper() + w[1:] if i == 0 or len(w) > 3 else w for i, w in enumerate(ws))


def markdown(t):
    parts = []
    for kind, lines in blocks(t):
        if kind == "heading":
            parts.append(("##" if len(lines[0]) <= 30 else "###") + " " + title(lines[0]))
        elif kind == "list":
            parts += lines
        else:
            parts.append("---" if kind == "separator" else "\n".join(lines))
    return "\n\n".join(parts)


def test_structure(frame, texts):
    assert column(frame, ops.structured(F.col("text"))) == [markdown(t) for t in texts]
    rows = {}
    for r in ops.structure_blocks(frame, "doc_id").orderBy("doc_id", "block_ix").collect():
        rows.setdefault(r.doc_id, []).append((r.type, list(r.lines)))
    assert [rows.get(i, []) for i in range(len(texts))] == [blocks(t) for t in texts]


def test_spacing_and_language(spark):
    cases = {"D e v i s   N °": "Devis N°", "a b": "a b", "Bonjour le monde": "Bonjour le monde", "H e l l o": "Hello"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = column(df, ops.collapse_letter_spacing(F.col("text")))
    assert got[1:] == list(cases.values())[1:] and got[0].replace(" ", "") == "DevisN°"
    said = {"court é": "eng", "Une phrase française à l'été": "fra", "Straße und Bäume über": "deu", "El niño come ñoquis": "spa", "plain english words": "eng", "ação e coração não": "por"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")
    got = column(df, ops.detect_language(F.col("text")))
    assert got == ["eng", "fra", "deu", "spa", "eng", "por"]
    scripts = spark.createDataFrame([(0, "Cyrillic"), (1, "Klingon")], "doc_id long, text string")
    assert column(scripts, ops.script_language(F.col("text"))) == ["rus", "eng"]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda e: one.select(e.alias("v")).first().v
    assert value(fn.column_index(F.lit("AB12"))) == 27 and value(fn.column_letters(F.lit(27))) == "AB" and value(fn.column_letters(F.lit(702))) == "AAA"
    assert value(fn.sheet_name(F.lit("a/b:c" + "é" * 30))) == "a_b_c" + "é" * 13
    assert value(fn.format_number(F.lit(12.50))) == "12.5" and value(fn.format_number(F.lit(3.0))) == "3"
    assert value(fn.human_size(F.lit(1536))) == "1.5 Ko" and value(fn.human_size(F.lit(5))) == "5 o" and value(fn.human_size(F.lit(2 * 1024**2))) == "2 Mo"
    assert value(fn.points(F.lit("16px"))) == 12.0 and value(fn.points(F.lit("2em"))) == 24.0 and value(fn.points(F.lit("9pt"))) == 9.0
    assert value(fn.resolve_path(F.lit("ppt/slides/slide1.xml"), F.lit("../media/x.png"))) == "ppt/media/x.png"
    assert value(fn.color_rgb(F.lit("#FF0080")))[0] == 1.0
    assert value(fn.wrap(F.lit("aa bb cc"), "Courier", 10.0, 36.0)) == ["aa bb", "cc"]
    assert value(fn.match_case(F.lit("ABC"), F.lit("xyz"))) == "XYZ" and value(fn.match_case(F.lit("Abc"), F.lit("xyz"))) == "Xyz"
    assert value(ops.strip_control(F.lit("a\x01b\r\nc"))) == "ab\nc"
    assert value(fn.byte_distance(F.lit("é"), F.lit("e"))) == 2
    assert value(fn.escape_html(F.lit("<a href='x'>&"))) == "&lt;a href=&#039;x&#039;&gt;&amp;"


def test_pipeline_from_config(frame):
    assert from_config({}) is None and from_config({"enabled": False}) is None
    assert from_config({"patterns": False}).names == ["ocr_confusion", "structure_detector"]
    layers = from_config({"structure": {"emit_markdown": False}})
    assert layers.names == ["ocr_confusion", "pattern_validator", "structure_detector"]
    out = layers(frame)
    assert {"entities", "structure"} <= set(out.columns) and out.count() == frame.count()
