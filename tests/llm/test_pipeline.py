"""The corpus pipeline stage by stage, and on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vellum.llm import simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    out["documents"] = docs
    for name, f in cp.STAGES:
        path = f"/tmp/checkpoints/test-{spark.sparkContext.applicationId}-{name}"
        f(spark, docs, sf).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "mix_sources", "best_fit_packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_near_copies_against_brute_force(stages):
    rows = sorted((r.doc_id, r.text) for r in stages["line_dedup"].collect())
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    sets = [simhash.shingle_set((t or "").encode(), 5) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1.0) >= 0.8:
                at[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    assert {r.doc_id for r in stages["simhash_dedup"].collect()} == set(low.values())


def test_mix_repeats_documents(stages):
    before = {r.doc_id: r.text for r in stages["simhash_dedup"].collect()}
    after = stages["mix_sources"].collect()
    assert after and all(before[r.doc_id] == r.text for r in after)


def test_packing_holds_the_mix(stages):
    words = sum(len((r.text or "").encode().split()) for r in stages["mix_sources"].collect())
    assert stages["best_fit_packing"].agg(F.sum("length")).first()[0] == words


def test_odd_tables(spark, sf):
    text = "some words that make a line of text which is long enough to count\nand another"
    rows = [(1, text, "en", "a", 5, "k"), (1, text, "en", "a", 5, "k"), (None, None, None, None, None, None), (2, "", "en", "b", 0, "k"), (3, "word " * 30_000, "en", None, 1, None), (4, text + " tail", "de", "a", 2, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `own.copies` string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, f in cp.STAGES[:-1]:
            docs = f(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "own.copies"], name
            docs = spark.createDataFrame(docs.collect(), schema)
        cp.STAGES[-1][1](spark, docs, sf).collect()


def test_texts_are_shuffled_once_at_the_end_of_a_stage(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (None, "a b c d", None, "x"), (3, None, "s", "z")], "doc_id long, text string, source string, extra string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, shuffles in ((cp.drop_copies, 2), (cp.mix_sources, 7)):
            plan = stage(spark, docs, None)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == shuffles, stage.__name__
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [12, 25, 33])
def test_meetings_of_variants_made_where_they_lie(spark, bits):
    prints = sorted({(f, (k * 2654435761 >> 3) % (1 << bits) ^ 1 << (k + f) % bits ^ 1 << j % bits) for k in range(60) for f in range(2) for j in range(k % 4)})
    xs = [f << bits + 6 | b << 6 | simhash.UNFLIPPED for f, b in prints]
    keys = spark.createDataFrame([(x,) for x in xs], "x long")
    at = {}
    for x in xs:
        for v in [x & -64] + [(x & -64) ^ 1 << j + 6 for j in range(bits)]:
            at.setdefault(v, []).append(x)
    want = sorted((x, v, len(m)) for v, m in at.items() if len(m) > 1 for x in m)
    assert want and sorted(tuple(r) for r in simhash.meet_packed(keys, bits, 2).collect()) == want
    assert simhash.sent_variants(keys, bits, simhash.dealt_bits(keys, bits, 2)).count() == 11 * len(xs)


def test_near_dedup_moves_numbers_in_place_of_md5(spark, monkeypatch):
    kinds = {}

    class Seen(simhash.Scratch):
        def written(self, df, name):
            kinds[name] = {c: k for c, k in df.dtypes if c in ("key", "root", "a", "b", "low", "v", "part")}
            return super().written(df, name)

    monkeypatch.setattr(simhash, "Scratch", Seen)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[: 60 - i % 2], f"x{i}"])) for i in range(6)] + [(9, "another text")]
    groups = {r.key: r.root for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(groups) == 6 and len(set(groups.values())) == 1 and set(groups) <= {hashlib.md5(t.encode()).hexdigest() for _, t in rows}
    assert {"members", "rooted", "candidates", "links"} <= set(kinds) and {k for of in kinds.values() for k in of.values()} == {"bigint"}
    assert simhash.sent_variants(spark.createDataFrame([(63,)], "x long"), 12, 10).columns == ["v"]  # nothing that v tells is sent beside it
