"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits both lie within r bits of some third value. So each *distinct*
fingerprint emits every value within half the radius (65 for 64 bits and radius 2), the shuffle deals the values out,
and fingerprints that meet at a value are candidates, which are verified. Rows that meet at one value are chained in
order, each to the next and to the first, so a group of k gives under 2k pairs; with an even radius all of them are
within the radius of each other, so no link between components is lost.

Components come from alternating large-star and small-star rounds over pairs, each round a table in the shared folder.

Cases: a text without words (null, empty, only spaces) has fingerprint zero and links like any other; texts of any length are
whole; repeated rows and equal texts share a fingerprint, which is linked once; null ids are allowed and never become a
component's id unless all its ids are null; an empty table gives an empty result; other input columns may have any name.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, map_rows, numbered, one_of_each, remove, table, utf8_values, written

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of all words if there are fewer; nothing without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:z], SEED) for a, z in zip(begins, ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray, ties: int = 0) -> int:
    """A bit is 1 if it is set in over half of the hashes, and as in ties if it is set in just half."""
    n, ones = hashes.size, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        return 0
    over, half = (int(np.packbits(x, bitorder="little").view("<u8")[0]) for x in (2 * ones > n, 2 * ones == n))
    return over | half & ties


def _remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further family of hashes; the first is the hashes themselves."""
    if not k:
        return hashes
    x = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_prints(hashes: np.ndarray, families: int) -> list[int]:
    """Fingerprints of the *set* of hashes, whose bits differ as the sets do, however often a shingle is repeated.

    Bits that just half of the hashes have are those of the least hash, so that few hashes give as many ones as zeros.
    """
    hashes = np.unique(hashes)
    return [majority(x, int(x[0]) if x.size else 0) for x in (_remix(hashes, k) for k in range(families))]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, families: int = 0) -> DataFrame:
    """id and fp, one row per input row: the signed 64-bit fingerprint of all shingles, or with families as many of their set."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in utf8_values(batch.column(1)):
            hashes = shingle_hashes(text, width)
            rows.append(np.array(set_prints(hashes, families) if families else [majority(hashes)], np.uint64).view(np.int64))
        return {"id": batch.column(0), "fp": pa.array(rows, pa.list_(pa.int64()))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, fp array<long>").withColumnRenamed("id", id_col)


def ball(bits: int, half: int) -> list[int]:
    """Masks of at most half set bits among bits, as signed 64-bit numbers."""
    masks, layer = [0], [(0, -1)]
    for _ in range(half):
        layer = [(m | 1 << b, b) for m, top in layer for b in range(top + 1, bits)]
        masks += [m for m, _ in layer]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def meet(keys: DataFrame, radius: int, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` of keys, a < b, that differ in at most radius bits.

    Not all pairs of a component, but a set that connects it.
    """
    if radius % 2:
        raise ValueError("an even radius: half of it is emitted by either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius // 2)])
    emitted = keys.select("fp", F.explode(masks).alias("_mask")).select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("_at"))
    spot = W.partitionBy("_at").orderBy("fp")
    found = emitted.select("fp", F.lag("fp").over(spot).alias("_before"), F.first("fp").over(spot).alias("_first"))
    pairs = found.where("_before IS NOT NULL").select(F.explode(F.array_distinct(F.array("_before", "_first"))).alias("a"), F.col("fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the component's smallest node.

    Large-star, then small-star rounds, until all pairs are stars. Minima and pairs are tables in the shared folder: a lost
    executor costs a task, and a hub's pairs are joined with its minimum by a join whose sides are dealt out by itself
    alone, so Spark can split a hub that holds a large part of all pairs. Nothing gathers a hub's neighbours.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        table, path = written(df, "pairs")
        paths.append(path)
        return table

    def with_least(pairs: DataFrame, also_itself: bool) -> DataFrame:
        """pairs with m, the least b of each a (or a itself, if that is less)."""
        low = pairs.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        low = kept(low.select("k", F.least("k", "m").alias("m")) if also_itself else low)
        return pairs.join(low, F.col("a") == F.col("k")).drop("k")

    def down(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").distinct()

    now = kept(down(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = kept(down(with_least(both, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = with_least(large, False)
        small = least.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, paths = paths, []
        now = kept(down(small))
        for path in before:
            remove(spark, path)
        several = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if not several.unionByName(now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")).limit(1).count():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (hex) and component_id (the smallest id reachable) for each row."""
    prints, _ = written(fingerprints(df, id_col, text_col, width).select(F.col(id_col).alias("id"), F.col("fp")[0].alias("fp")), "fingerprints")
    distinct, _ = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(meet(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_print, _ = written(rooted.join(lowest, "root").select("fp", "component"), "components")
    out = prints.join(of_print, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_simhash_ball(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Near-copies by similarity of word shingles: several shorter fingerprints, every candidate pair verified on its texts.

WIDTH, SIMILARITY = 5, 0.8
#: Share of the pairs of just that similarity which shall meet, and what asking a pair that meets by chance costs, in emitted variants.
RECALL, STRANGER_COST = 0.9, 16.0
#: Variants that a text emits at once; the families are dealt over as many rounds as that takes, which bounds the shuffled bytes of a round.
ROUND_ROWS = 128
#: In a packed fingerprint the lowest six bits tell which bit is flipped; this value: none.
UNFLIPPED = 63


def differing_share(least: float) -> float:
    """Share of the bits in which fingerprints of two sets of Jaccard similarity `least` differ: by the angle between them."""
    return math.acos(2 * least / (1 + least)) / math.pi


def meeting_share(bits: int, share: float) -> float:
    """Probability that two fingerprints of so many bits differ in at most two."""
    return sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(3))


def shape(texts: int, least: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits, families) for a corpus of so many distinct texts: those of least work for a text at the same recall at every size.

    Longer fingerprints take more families; but chance meetings with a fixed length would grow with the square of the corpus.
    """

    def families(bits: int) -> int:
        return math.ceil(math.log(1 - recall) / math.log1p(-meeting_share(bits, differing_share(least))))

    def work(bits: int) -> float:
        return families(bits) * (bits + 1 + STRANGER_COST * texts * meeting_share(bits, 0.5))

    bits = min(range(16, 49), key=work)
    return bits, families(bits)


def short_prints(bits: int, families: int, fp: str = "fp") -> list:
    """The families' fingerprints of `bits` bits, cut one after the other from the 64-bit words of the column fp."""
    out = []
    for at in range(0, bits * families, bits):
        word, start = divmod(at, 64)
        value = F.shiftrightunsigned(F.col(fp)[word], start)
        if start + bits > 64:
            value = value.bitwiseOR(F.shiftleft(F.col(fp)[word + 1], 64 - start))
        out.append(value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def packed(family: int, fp, bits: int):
    """Family, short fingerprint and UNFLIPPED in one number."""
    return F.lit(family << bits + 6).cast("long").bitwiseOR(F.shiftleft(fp, 6)).bitwiseOR(F.lit(UNFLIPPED))


def dealt_bits(keys: DataFrame, bits: int, families: int) -> int:
    """Of the bits, the highest by which variants are dealt out: 2 ** dealt * families values, 32 for each partition and 1,024 at least."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(bits, max(10, math.ceil(math.log2(32 * partitions / families))))


def sent_variants(keys: DataFrame, bits: int, dealt: int) -> DataFrame:
    """(v): each x of keys as it is and with each of its `dealt` highest bits flipped."""
    masks = [0] + [flip(j) for j in range(bits - dealt, bits)]
    return keys.select(F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_mask"), "x").select(F.col("x").bitwiseXOR(F.col("_mask")).alias("v"))


def flip(j: int) -> int:
    """What flips bit j of a packed fingerprint and says so in its lowest bits."""
    return (1 << j + 6) ^ UNFLIPPED ^ j


def meet_packed(keys: DataFrame, bits: int, families: int = 1) -> DataFrame:
    """As meet, for packed fingerprints `x` and radius 2: (x, at, n) for each value `at` at which n > 1 of them meet.

    A variant is one number, the flipped value and which bit is flipped. Variants are dealt out by the family and the highest
    bits of their value, so those with a lower bit flipped lie where the fingerprint itself does: they are made there, and the
    shuffle has only the variants of the highest bits.
    """
    dealt = dealt_bits(keys, bits, families)
    part = F.shiftright("v", bits - dealt + 6)  # the family and the highest bits, told from v on either side of the shuffle
    sent = sent_variants(keys, bits, dealt).repartition(part).withColumn("part", part)
    there = F.array(*[F.lit(m).cast("long") for m in [0] + [flip(j) for j in range(bits - dealt)]])
    mask = F.explode(F.when(F.col("v").bitwiseAND(F.lit(63).cast("long")) == UNFLIPPED, there).otherwise(F.array(F.lit(0).cast("long"))))
    emitted = sent.select("part", "v", mask.alias("_mask")).select("part", F.col("v").bitwiseXOR(F.col("_mask")).alias("v"))
    emitted = emitted.withColumn("at", F.col("v").bitwiseAND(F.lit(-64).cast("long")))
    x = F.expr(f"CASE WHEN v & 63 = {UNFLIPPED} THEN v ELSE v ^ shiftleft(1L, CAST(v & 63 AS INT) + 6) ^ ({UNFLIPPED}L ^ (v & 63)) END")
    return emitted.withColumn("n", F.count("*").over(W.partitionBy("part", "at"))).where("n > 1").select(x.alias("x"), "at", "n")


def first_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each x with the x of most meetings at each of its values, and with the least: linear in met.

    A text that many others are copies of meets more than they do, so it is asked for each of them, near to each other or not.
    """
    degrees = met.groupBy("x").agg(F.sum("n").alias("degree"))
    hubs = met.join(degrees, "x").groupBy("at").agg(F.max(F.struct("degree", "x")).alias("hub"), F.min("x").alias("low"))
    asked = met.select("x", "at").join(hubs.select("at", F.col("hub.x").alias("hub"), "low"), "at").select("x", F.explode(F.array("hub", "low")).alias("u")).where("u <> x")
    return asked.select(F.least("u", "x").alias("a"), F.greatest("u", "x").alias("b")).distinct()


def pairs_between(members: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (a, b), a < b, of the keys of members(at, key, root) that share an `at` and have different roots.

    The keys of a value's commonest root are only paired with its other keys, never with each other.
    """
    sizes = members.groupBy("at", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("at").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("at", F.col("m.root").alias("main"))
    mixed = scratch.written(mixed, "mixed-values")
    others = scratch.written(members.join(mixed, "at").where("root <> main").select("at", "main", F.col("key").alias("k"), F.col("root").alias("r")), "other-members")
    pairs = others.join(members, "at").where("r <> root AND (root = main OR k < key)")
    return pairs.select(F.least("k", "key").alias("a"), F.greatest("k", "key").alias("b")).distinct()


def most_differing(bits: int, least: float) -> int:
    """Differing bits that two texts of similarity `least` exceed once in 10 ** 9 pairs: six standard deviations more than the mean."""
    share = differing_share(least)
    return math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def shingle_set(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a: bytes, b: bytes, width: int) -> float:
    """Jaccard similarity of the word shingles; 1 if neither has a word."""
    x, y = shingle_set(a, width), shingle_set(b, width)
    return len(x & y) / len(x | y) if x or y else 1.0


def text_key(text):
    """md5 of the text, the same for all texts without words."""
    whole = F.coalesce(text, F.lit(""))
    return F.md5(F.when(F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")) == "", "").otherwise(whole))


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(key, root) of distinct texts: key is the text's md5, root that of its group (only texts linked to another).

    Two texts of similarity 0.8 differ in about 10 of 64 bits, beyond any ball that can be emitted. So each text has
    several shorter fingerprints of the set of its shingles (`shape`); texts that meet in any family within two bits are candidates.
    A pair links if the similarity of its word shingles is at least `least`; pairs whose fingerprints differ too much in all
    (`most_differing`) are not asked.

    First few pairs of each text are asked, which links most copies. Then all pairs that meet and are not yet in one group
    are, so the groups are those of all candidates, while the members of a large group are not compared with each other.
    Within all steps a text is a number, a quarter of its md5; the table that gives it is written once, so it stays the same.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        own = df.select(text_key(F.col(text_col)).alias("md5"), F.col(text_col).alias("text"))
        texts = scratch.written(own.select("md5").distinct(), "text-keys").count()
        bits, families = shape(texts, least, recall)
        words = -(-bits * families // 64)
        prints = fingerprints(own, "md5", "text", width, words).groupBy("md5").agg(F.min("fp").alias("fp"))
        prints = scratch.written(prints.withColumn("key", F.monotonically_increasing_id()), "prints")
        spots = [packed(k, p, bits) for k, p in enumerate(short_prints(bits, families))]
        a_round, met, here = max(1, ROUND_ROWS // (bits + 1)), [], []
        for at in range(0, families, a_round):
            with Scratch(spark) as short_lived:
                spot = prints.select("key", F.explode(F.array(*spots[at : at + a_round])).alias("x"))
                values = short_lived.written(spot.groupBy("x").agg(F.count("*").alias("c")), "family-prints")
                met.append(scratch.written(meet_packed(values.select("x"), bits, len(spots[at : at + a_round])), "meeting"))
                live = values.where("c > 1").select("x").unionByName(met[-1].select("x")).distinct()
                here.append(scratch.written(spot.join(live, "x", "left_semi"), "live-prints"))
            spark._jvm.System.gc()  # a round's shuffle files go when the driver has forgotten its plan
        groups = _groups(scratch, own, prints, functools.reduce(DataFrame.unionByName, met), functools.reduce(DataFrame.unionByName, here), width, least, 64 * words)
        name = lambda n: prints.select(F.col("key").alias(n), F.col("md5").alias(f"{n}_md5"))
        named = groups.join(name("key"), "key").join(name("root"), "root")
        return written(named.select(F.col("key_md5").alias("key"), F.col("root_md5").alias("root")), "copy-groups")[0]


def _groups(scratch: Scratch, own: DataFrame, prints: DataFrame, met: DataFrame, here: DataFrame, width: int, least: float, all_bits: int) -> DataFrame:
    """copy_groups by numbers, from the values at which packed fingerprints meet, met(x, at, n), and the texts that have them, here(key, x)."""
    spark = own.sparkSession
    lows = scratch.written(here.groupBy("x").agg(F.min("key").alias("low")), "family-lows")

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of keys that are similar."""
        with Scratch(spark) as passing:  # texts and what is asked go before the next step
            of = lambda n, f: prints.select(F.col("key").alias(n), F.col("fp").alias(f))
            differing = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
            asked = passing.written(pairs.join(of("a", "fa"), "a").join(of("b", "fb"), "b").where(differing <= most_differing(all_bits, least)).select("a", "b"), "close-candidates")
            wanted = asked.select(F.col("a").alias("key")).unionByName(asked.select(F.col("b").alias("key"))).distinct()
            wanted = passing.written(wanted.join(prints.select("key", "md5"), "key"), "candidate-keys")
            # where few texts are asked for, Spark's size check sends their keys out and no text is shuffled; else it can split the
            # join of a large group of copies, as nothing but the written table stands above it
            texts = passing.written(own.join(wanted, "md5").select("key", "text"), "candidate-rows")
            texts = passing.written(texts.groupBy("key").agg(F.first("text").alias("text")), "candidate-texts")
            both = asked.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

            def verify(batch: pa.RecordBatch) -> dict:
                near = [similarity(x, y, width) >= least for x, y in zip(utf8_values(batch.column(2)), utf8_values(batch.column(3)))]
                return {"a": batch.column(0), "b": batch.column(1), "near": near}

            found = scratch.written(map_rows(both, verify, "a long, b long, near boolean").where("near").select("a", "b"), "links")
        spark._jvm.System.gc()  # their shuffle files, too
        return found

    equal = here.join(lows, "x").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    low_a, low_b = lows.select(F.col("x").alias("a"), F.col("low").alias("key_a")), lows.select(F.col("x").alias("b"), F.col("low").alias("key_b"))
    close = first_pairs(met).join(low_a, "a").join(low_b, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    first = scratch.written(equal.unionByName(close).where("a <> b").select(*ordered("a", "b")).distinct(), "candidates")
    groups = scratch.written(components(links(first)).withColumnRenamed("node", "key"), "linked")

    with Scratch(spark) as passing:
        rooted = passing.written(here.join(groups, "key", "left").select("x", "key", F.coalesce("root", "key").alias("root")), "rooted")
        # texts of one value share that value itself, whose lowest bits no meeting value has
        members = rooted.join(met.select("x", "at"), "x").select("at", "key", "root").unionByName(rooted.select(F.col("x").alias("at"), "key", "root"))
        members = passing.written(members, "members")
        rest = scratch.written(pairs_between(members, passing).join(first, ["a", "b"], "left_anti"), "other-candidates")
    spark._jvm.System.gc()
    if not rest.limit(1).count():
        return groups
    stars = groups.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    return scratch.written(components(stars.unionByName(links(rest))).withColumnRenamed("node", "key"), "linked")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """df with one document of each group: that of the smallest id (then of the first text hash); equal texts are a group.

    Texts without words are one group. Of rows that repeat both id and text the one with the least hash of its other columns stays.
    """
    names, rows = df.columns, numbered(df)
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    key = text_key(F.col(text_col))
    ids = rows.select(F.col(id_col).alias("id"), key.alias("key")).groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("low"))
    groups = copy_groups(rows, id_col, text_col, width, least)
    rooted = ids.join(groups, "key", "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("low.none", "low.id", "key")).alias("s")).select(F.struct(F.col("s.key").alias("key"), F.col("s.id").alias("id")).alias("spot"))
    stay, _ = written(stay, "stay")
    # text and id as one value, by which texts are shuffled once: for the join and for the choice among equal rows
    kept = rows.withColumn("spot", F.struct(key.alias("key"), F.col(id_col).alias("id")).cast(stay.schema["spot"].dataType)).join(stay, "spot")
    kept = one_of_each(kept, ["spot"], [c for c in rows.columns if c not in (id_col, text_col)])
    return kept.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names)])
