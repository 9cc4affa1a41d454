"""Operator 5: best-fit packing into bins of several permitted lengths, chosen jointly.

A sequence of c tokens costs price(c): its tokens, a share for attention that grows with c * c, and a fixed part; so short
sequences are cheaper for each token, if they get full, and long ones hold what short ones can't. Pieces (documents, cut
into runs of at most the largest length) are packed in falling order of length. A piece goes to the open bin that it fills best;
if none has room, a bin opens at the length of least price for each token that it would hold, with the piece and what best fit
could put beside it from the pieces still to come; at the end every bin shrinks to the least permitted length that holds it.

Documents are dealt into blocks by a hash; the number of blocks follows the table's row count, so a block has about
BLOCK_DOCS documents whatever the source or the copies, and only ids and lengths are shuffled. Blocks are packed
independently (a block wastes part of a few bins at most).

Cases: documents of length 0 (null or empty texts) need no bin and give a row with null bin_id; longer documents than the
largest bin are cut into pieces that together hold every token; repeated rows are packed each for itself, however many there
are; ties go in the order of id, then piece, and among lengths to the longer; null ids are allowed; an empty table gives an empty
result; other input columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, word_count, written

LENGTHS = (256, 512, 1024, 2048)
#: What a sequence costs beyond its length (its separate start, attention mask and scheduling), in tokens.
OVERHEAD = 8
#: Attention of a token over a sequence of this many tokens costs as much as the rest of the token's work.
ATTENTION_SPAN = 6144
BLOCK_DOCS = 20_000


def price(length: int, overhead: int = OVERHEAD, span: int = ATTENTION_SPAN) -> float:
    """Cost of a sequence in tokens of a sequence without attention."""
    return length + length * length / span + overhead


def would_hold(room: int, coming: list[int], sizes: int) -> int:
    """Tokens that best fit puts into room from the pieces to come: always the longest that fits, as often as there is one.

    coming: pieces to come of each size; sizes: bit s is set if there are any of size s.
    """
    held = 0
    while room > 0 and (fit := sizes & ((1 << room + 1) - 1)):
        size = fit.bit_length() - 1
        held += size * min(coming[size], room // size)
        room -= size * min(coming[size], room // size)
        sizes &= (1 << size) - 1
    return held


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, span: int = ATTENTION_SPAN) -> list[tuple[int, int, int]]:
    """For each piece (sizes: 1 to max(lengths), falling) its (bin, offset in the bin, final length of the bin)."""
    most = max(lengths)
    options = sorted(((c, price(c, overhead, span)) for c in lengths), reverse=True)
    # pieces of each size still to come
    coming, any_of = [0] * (most + 1), 0
    for s in sizes:
        coming[s] += 1
        any_of |= 1 << s
    room_of: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by free room
    rooms = 0  # bit r: some bin has room r
    used: list[int] = []
    placed = []
    for s in sizes:
        coming[s] -= 1
        if not coming[s]:
            any_of &= ~(1 << s)
        above = rooms >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            k = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            fits = [(cost / (s + would_hold(c - s, coming, any_of)), -c) for c, cost in options if c >= s]
            k, room = len(used), -min(fits)[1]
            used.append(0)
        placed.append((k, used[k]))
        used[k] += s
        left = room - s
        if left:
            room_of[left].append(k)
            rooms |= 1 << left
    final = [min(c for c in lengths if c >= u) for u in used]
    return [(k, at, final[k]) for k, at in placed]


def pack_documents(df: DataFrame, size_col: str = "size", id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, block_docs: int = BLOCK_DOCS, salt=None, span: int = ATTENTION_SPAN) -> DataFrame:
    """id, piece, start, length, bin_id, bin_offset, bin_length: where each run of each document lies.

    start and length are in the unit of size_col; bin_id is `block-bin`. salt: a further column that tells rows of one id apart.
    """
    most, kind = max(lengths), df.schema[id_col].dataType.simpleString()
    rows, _ = written(df.select(df[id_col].alias("id"), F.coalesce(df[size_col], F.lit(0)).cast("long").alias("size"), (salt if salt is not None else F.lit(0)).cast("long").alias("salt"), F.monotonically_increasing_id().alias("row")), "pack-sizes")
    blocks = max(1, -(-rows.count() // block_docs))
    # row is read from the written table, so a task that runs again deals alike, and many rows of one id are dealt out too
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "salt", "size", "row"), F.lit(blocks)).cast("long"))

    def run(part: pa.Table) -> pa.Table:
        pieces = []
        for i, size, salt in zip(*(part.column(c).to_pylist() for c in ("id", "size", "salt"))):
            pieces += [(i, salt, k, at, min(most, size - at)) for k, at in enumerate(range(0, size, most))]
        pieces.sort(key=lambda p: (-p[4], p[0] is not None, p[0] if p[0] is not None else 0, p[1], p[2]))
        spots = pack([p[4] for p in pieces], lengths, overhead, span)
        block = part.column("block")[0].as_py()
        ids = pa.array([p[0] for p in pieces], part.schema.field("id").type)
        numbers = [pa.array(x, pa.int64()) for x in ([p[2] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], [x[1] for x in spots], [x[2] for x in spots])]
        bins = pa.array([f"{block}-{x[0]}" for x in spots], pa.string())
        return pa.Table.from_arrays([ids, *numbers[:3], bins, *numbers[3:]], names=["id", "piece", "start", "length", "bin_id", "bin_offset", "bin_length"])

    packed = rows.where("size > 0").groupBy("block").applyInArrow(run, f"id {kind}, piece long, start long, length long, bin_id string, bin_offset long, bin_length long")
    nothing = rows.where("size = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("long").alias("bin_length"))
    return packed.unionByName(nothing).withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs.select("doc_id", word_count(docs["text"]).alias("size")))
