"""Layout of positioned text: lines, clusters, tables and slides.

The sequential rules are plain functions over one page's segments, which a page's task applies; those that a window can
express are DataFrame operators as well.
"""

from __future__ import annotations

from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import model as m

LINE_GAP, CLUSTER_GAP, COLUMN_GAP, ROW_GAP, COLUMN_TOLERANCE = 2.0, 40.0, 300.0, 15.0, 15.0

Segment = tuple[str, float, float]


def reading_order(segments: list[Segment]) -> list[Segment]:
    """From the top down, and from left to right where heights differ by at most 2."""
    return sorted(segments, key=cmp_to_key(lambda a, b: (b[2] - a[2] > 0) - (b[2] - a[2] < 0) if abs(b[2] - a[2]) > LINE_GAP else (a[1] > b[1]) - (a[1] < b[1])))


def group_lines(segments: list[Segment]) -> list[list[Segment]]:
    """Neighbours whose height is within 2 of their line's first segment."""
    out: list[list[Segment]] = []
    for s in segments:
        if out and abs(s[2] - out[-1][0][2]) < LINE_GAP:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def clusters(line: list[Segment], gap: float = CLUSTER_GAP) -> list[list[Segment]]:
    """Segments from left to right, parted where the step from one to the next is over the gap."""
    out: list[list[Segment]] = []
    for s in sorted(line, key=lambda x: x[1]):
        if out and s[1] - out[-1][-1][1] <= gap:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def columns_of(line: list[Segment]) -> list[float]:
    return sorted(c[0][1] for c in clusters(line))


def like_a_row(columns: list[float]) -> bool:
    """At least three columns, none over 300 from the next."""
    return len(columns) >= 3 and all(b - a <= COLUMN_GAP for a, b in zip(columns, columns[1:]))


def into_columns(line: list[Segment], columns: list[float]) -> list[str]:
    """Each segment to the nearest column, the left one of equals; texts of a column joined by spaces."""
    cells: list[list[str]] = [[] for _ in columns]
    for text, x, _ in line:
        cells[min(range(len(columns)), key=lambda k: (abs(x - columns[k]), k))].append(text)
    return [" ".join(c) for c in cells]


def take_table(lines: list[list[Segment]], start: int) -> tuple[list[list[str]], int] | None:
    """The rows of a table that begins at a line, and the line after it; None if it has under two rows.

    A line belongs if most of its clusters stand at the table's columns; within 15 of the line before it continues its row.
    """
    columns = columns_of(lines[start])
    height = lambda line: sum(s[2] for s in line) / len(line)
    rows, i = [into_columns(lines[start], columns)], start + 1
    while i < len(lines):
        found = [c[0][1] for c in clusters(lines[i])]
        meets = sum(any(abs(x - c) < COLUMN_TOLERANCE for c in columns) for x in found)
        if meets < (1 if len(found) == 1 else max(2, -(-len(found) * 3 // 5))):
            break
        new = into_columns(lines[i], columns)
        if height(lines[i - 1]) - height(lines[i]) >= ROW_GAP:
            rows.append(new)
        else:
            rows[-1] = [" ".join(x for x in pair if x) for pair in zip(rows[-1], new)]
        i += 1
    return (rows, i) if len(rows) >= 2 else None


def page_elements(segments: list[Segment], garbage, collapse) -> list[dict]:
    """Tables and lines of text of a page; `garbage` and `collapse` judge and mend a line's text."""
    lines, out, i = group_lines(reading_order(segments)), [], 0
    while i < len(lines):
        found = take_table(lines, i) if like_a_row(columns_of(lines[i])) else None
        if found:
            rows, i = found
            out.append(m.table([(k == 0, [c.strip() for c in r]) for k, r in enumerate(rows)]))
            continue
        text = collapse(" ".join(s[0] for s in lines[i]).strip())
        if text and not garbage(text):
            out.append(m.paragraph(text))
        i += 1
    return out


# The same over DataFrames of segments


def line_groups(segments: DataFrame, keys: list[str], order: str = "seg_ix") -> DataFrame:
    """segments(keys, order, text, x, y) with `line_ix`, the line of each by group_lines in the given order.

    A line's anchor is its first segment, which no window can carry, so each page is one group of an Arrow function.
    """
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", line_ix int"

    def run(page: pa.Table) -> pa.Table:
        page = page.sort_by(order)
        index, anchor, k = [], None, -1
        for y in page.column("y").to_pylist():
            if anchor is None or abs(y - anchor) >= LINE_GAP:
                anchor, k = y, k + 1
            index.append(k)
        return page.append_column("line_ix", pa.array(index, pa.int32()))

    return segments.groupBy(*keys).applyInArrow(run, out)


def x_clusters(segments: DataFrame, keys: list[str], gap: float = CLUSTER_GAP, order: str = "seg_ix") -> DataFrame:
    """segments with `cluster_ix`, from left to right within each line (keys)."""
    line = W.partitionBy(*keys).orderBy("x", order)
    new = F.coalesce((F.col("x") - F.lag("x").over(line) > gap).cast("int"), F.lit(0))
    return segments.withColumn("_new", new).withColumn("cluster_ix", F.sum("_new").over(line).cast("int")).drop("_new")


def table_like_lines(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_clusters, widest): lines of at least three clusters, none over 300 from the next."""
    firsts = clustered.groupBy(*keys, "cluster_ix").agg(F.min("x").alias("x"))
    line = W.partitionBy(*keys).orderBy("cluster_ix")
    stepped = firsts.withColumn("step", F.col("x") - F.lag("x").over(line))
    return stepped.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.max("step").alias("widest")).where((F.col("n_clusters") >= 3) & (F.col("widest") <= COLUMN_GAP))


def nearest_column(segments: DataFrame, columns: list[float]) -> DataFrame:
    """segments with `column`, the index of the nearest x, the left one of equals."""
    options = F.array(*[F.struct(F.abs(F.col("x") - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(columns)])
    return segments.withColumn("column", F.array_min(options)["k"])


def slide_groups(texts: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """texts with `slide_ix`: a text under 80 characters after one over 100 begins a slide; up to three texts are one."""
    spot, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    new = F.coalesce(((F.length(text) < 80) & (F.lag(F.length(text)).over(spot) > 100)).cast("int"), F.lit(0))
    out = texts.withColumn("_new", new).withColumn("_n", F.count("*").over(whole))
    return out.withColumn("slide_ix", F.when(F.col("_n") <= 3, 0).otherwise(F.sum("_new").over(spot)).cast("int")).drop("_new", "_n")
