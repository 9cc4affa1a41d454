"""Spelling and context correction against plain-Python twins that look at every word of the dictionary."""

import re
import unicodedata
from collections import Counter

import pytest

from vellum.operators import correct, train
from vellum.operators.train import NgramModel

CORPUS = ["the quick brown fox jumps over the lazy dog", "the quick brown bear sleeps", "quick brown foxes", "l'été arrive vite", "the lazy dog sleeps", "Société générale du nord"] * 3
NOISY = ["the quikc brown fox", "teh quick brpwn fox, jumps", "Jean Dupond likes the quick brovn Bear", "THE LAZI DOG", "ete arrive vitte", "un\nquick broxn fox\n\nend", "brownn. fox", "Quick Brpwn fox", "société genérale"]

is_letter = lambda c: unicodedata.category(c).startswith("L")
only = lambda s: "".join(c for c in s if is_letter(c))
tokens = lambda line: [t for t in re.split(r"(\s+)", line)]


def distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def cased(original, word):
    if original.upper() == original:
        return word.upper()
    return word[:1].upper() + word[1:] if original[:1].isupper() else word


def spell(text, words, least_length, least_freq, most):
    made, out = [], []
    for line in text.split("\n"):
        parts = tokens(line)
        at = [i for i, t in enumerate(parts) if any(map(is_letter, t))]
        original = parts.copy()
        for p, i in enumerate(at):
            w = only(original[i])
            if len(w) < least_length or w.lower() in words:
                continue
            cap = lambda t: t[:1].isupper()
            title = lambda t: len(t) > 1 and t[0].isupper() and t[1].islower()
            if title(w) and ((p and cap(original[at[p - 1]])) or (p + 1 < len(at) and title(original[at[p + 1]]))):
                continue
            near = [(distance(w.lower(), c), -f, c) for c, f in words.items() if abs(len(c) - len(w)) <= most]
            best = min((n for n in near if n[0] <= most), default=None)
            if best and -best[1] >= least_freq:
                new = cased(w, best[2])
                made.append((w, new))
                parts[i] = parts[i].replace(w, new)
        out.append("".join(parts))
    return "\n".join(out), made


@pytest.fixture(scope="module")
def frames(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id long, text string")
    noisy = spark.createDataFrame([(i, t) for i, t in enumerate(NOISY)], "doc_id long, text string")
    return corpus, noisy


@pytest.mark.parametrize("most", [1, 2])
def test_spelling(frames, most):
    corpus, noisy = frames
    words = Counter()
    for t in CORPUS:
        words.update(w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 2)
    out = correct.spell_correct(noisy, train.dictionary(corpus), distance=most, min_length=4, min_frequency=3).orderBy("doc_id").collect()
    for t, r in zip(NOISY, out):
        want, made = spell(t, words, 4, 3, most)
        assert r.text == want and [tuple(c) for c in r.corrections] == made, t


def ngram(text, uni, bi, ratio=3.0, most=1):
    total = sum(uni.values())
    p2 = lambda a, b: bi[a, b] / uni[a] if uni[a] else 0.0

    def score(w, before, after):
        return uni[w] / total + (2 * p2(before, w) if before is not None else 0) + (2 * p2(w, after) if after is not None else 0)

    out, made = [], []
    for line in text.split("\n"):
        parts = tokens(line)
        at = [i for i, t in enumerate(parts) if any(map(is_letter, t))]
        ws = [only(parts[i]) for i in at]
        for j, w in enumerate(ws if len(ws) >= 2 else []):
            if len(w) < 4 or w.lower() in uni:
                continue
            caps = w.upper() == w and len(w) > 3
            if w[0].isupper() and not caps and ((j and ws[j - 1][0].isupper()) or (j + 1 < len(ws) and ws[j + 1][0].isupper())):
                continue
            before, after = ws[j - 1].lower() if j else None, ws[j + 1].lower() if j + 1 < len(ws) else None
            limit = max(score(w.lower(), before, after) * ratio, 5 / total)
            best = min(((-score(c, before, after), -f, c) for c, f in uni.items() if abs(len(c) - len(w)) <= most and 1 <= distance(w.lower(), c) <= most), default=None)
            if best and -best[0] > limit:
                made.append((w, best[2]))
                parts[at[j]] = cased(only(parts[at[j]]), best[2])
        out.append("".join(parts))
    return "\n".join(out), made


def test_context(frames):
    corpus, noisy = frames
    uni, bi = Counter(), Counter()
    for t in CORPUS:
        ws = [w for w in re.findall(r"(?:[^\W\d_]|')+", t.lower()) if len(w) >= 2]
        uni.update(ws)
        bi.update(zip(ws, ws[1:]))
    out = correct.ngram_correct(noisy, NgramModel.train(corpus)).orderBy("doc_id").collect()
    for t, r in zip(NOISY, out):
        want, made = ngram(t, uni, bi)
        assert r.text == want and [tuple(c) for c in r.ngram_corrections] == made, t


def test_dictionary_files(spark, frames, tmp_path):
    words = train.dictionary(frames[0])
    train.save_dictionary(words, str(tmp_path / "dict"))
    back = train.load_dictionary(spark, str(tmp_path / "dict"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, words.collect()))
    (tmp_path / "hand.txt").write_text("# words\nBonjour\nmonde\t7\n\nmonde\t9\n", encoding="utf-8")
    assert sorted(map(tuple, train.load_dictionary(spark, str(tmp_path / "hand.txt")).collect())) == [("bonjour", 1), ("monde", 9)]
    assert dict(map(tuple, train.add_words(back, {"NEU": 5}).collect()))["neu"] == 5


def test_models(spark, frames, tmp_path):
    model = NgramModel.train(frames[0])
    parts = [NgramModel.train(frames[0].where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    both = parts[0].append(parts[1])
    assert both.stats().first() == model.stats().first()
    model.save(str(tmp_path / "model"))
    again = NgramModel.import_json(spark, NgramModel.load(spark, str(tmp_path / "model")).export_json())
    assert sorted(map(tuple, again.bigrams.collect())) == sorted(map(tuple, model.bigrams.collect()))


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("un deux")
    (tmp_path / "a" / "b" / "two.md").write_text("trois quatre")
    (tmp_path / "a" / "skip.bin").write_text("cinq")
    (tmp_path / "named.bin").write_text("six sept")
    got = {r.word for r in train.dictionary(train.read_corpus(spark, str(tmp_path / "a"), str(tmp_path / "named.bin"))).collect()}
    assert got == {"un", "deux", "trois", "quatre", "six", "sept"}
