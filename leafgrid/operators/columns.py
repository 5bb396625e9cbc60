"""Column detection and reading order.

A page's items are divided at the widest band of vertical positions that hardly any item crosses, twice at most; the resulting
groups are put in reading order. ``gutters`` is the search alone, ``reading_order`` the whole recursion, both on numpy arrays of one row per page.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
MIN_ITEMS, MAX_DEPTH, STEP, INSET, WIDE = 4, 2, 0.01, 0.1, 0.5
CROSSING_SHARE, NARROW_SHARE, NARROW_LEAST, SIDE_ITEMS, SIDE_SHARE = 0.35, 0.08, 2, 2, 0.05


def positions(start: float, end: float) -> list[float]:
    """From start on, adding STEP each time (the sums, not multiples, are compared with item borders)."""
    width = end - start
    n = int((width * (1 - 2 * INSET) + 1e-9) / STEP) + 3
    limit = end - width * INSET + 1e-9
    return [x for x in accumulate(repeat(STEP, n), initial=start + width * INSET) if x <= limit]


def gutters(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, start, end): the widest band of valid positions over the whole page width, the leftmost of equals."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, found = b.column(2), []
            at = lists.offsets.to_numpy()
            x, w = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "w"))
            for s, e in zip(at[:-1], at[1:]):
                narrow = w[s:e] <= WIDE
                found.append(widest(x[s:e], w[s:e], narrow, 0.0, 1.0) if min(e - s, narrow.sum()) >= MIN_ITEMS else None)
            band = [pa.array([f and float(f[k]) for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *band], ["doc_id", "page_no", "start", "end"])

    packed = items.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))).alias("items"))
    kinds = [f"{c} {packed.schema[c].dataType.simpleString()}" for c in PAGE]
    return packed.mapInArrow(search, ", ".join([*kinds, "start double", "end double"])).filter("start is not null")


def widest(x: np.ndarray, w: np.ndarray, narrow: np.ndarray, start: float, end: float) -> tuple[float, float] | None:
    g = np.array(positions(start, end))
    if not len(g):
        return None
    crosses = (x[:, None] < g) & (x[:, None] + w[:, None] > g)
    left = x[:, None] + w[:, None] / 2 < g
    inner = narrow[:, None] & ~crosses
    nl, nr = (inner & left).sum(0), (inner & ~left).sum(0)
    few = np.minimum(nl, nr)
    ok = (crosses.sum(0) <= len(x) * CROSSING_SHARE) & ((crosses & narrow[:, None]).sum(0) <= max(NARROW_LEAST, int(narrow.sum() * NARROW_SHARE))) & (few >= SIDE_ITEMS) & (few >= (nl + nr) * SIDE_SHARE)
    edge = np.flatnonzero(np.diff(np.r_[0, ok.astype(np.int8), 0]))
    bands = [(g[a], g[b - 1]) for a, b in zip(edge[::2], edge[1::2])]
    return max(bands, key=lambda b: b[1] - b[0], default=None)  # the first of equals


def split(at: np.ndarray, x: np.ndarray, w: np.ndarray, start: float = 0.0, end: float = 1.0, depth: int = 0) -> list[np.ndarray]:
    """Groups of item indices."""
    narrow = w[at] <= (end - start) * WIDE
    if depth >= MAX_DEPTH or len(at) < MIN_ITEMS or end <= start or narrow.sum() < MIN_ITEMS or (band := widest(x[at], w[at], narrow, start, end)) is None:
        return [at]
    middle = (band[0] + band[1]) / 2
    crossing = (x[at] < middle) & (x[at] + w[at] > middle)
    left = ~crossing & (x[at] + w[at] / 2 < middle)
    return [*split(at[left], x, w, start, middle, depth + 1), *split(at[~crossing & ~left], x, w, middle, end, depth + 1), *([k] for k in at[crossing])]


def arranged(groups: list, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Groups in reading order: side by side ones by their left edge, others by their top. The rule isn't transitive, so each group is
    inserted from the end of those before it."""
    out: list[tuple] = []
    for g in (np.asarray(g) for g in groups if len(g)):
        key = (x[g].min(), y[g].min(), (y[g] + h[g]).max(), g)
        k = len(out)
        while k and after(out[k - 1], key):
            k -= 1
        out.insert(k, key)
    return [k[3] for k in out]


def after(a: tuple, b: tuple) -> bool:
    beside = min(a[2], b[2]) - max(a[1], b[1]) > 0.5 * min(a[2] - a[1], b[2] - b[1])
    return a[0] > b[0] if beside else a[1] > b[1]


def order_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, number: np.ndarray, by_x: bool) -> tuple[np.ndarray, np.ndarray]:
    """(column of each item, its reading order). Within a column by y (and x, for line pages), then by number."""
    column, order = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    start = 0
    for c, g in enumerate(arranged(split(np.arange(len(x)), x, w), x, y, h)):
        g = g[np.lexsort((number[g], x[g], y[g]) if by_x else (number[g], y[g]))]
        column[g], order[g] = c, np.arange(start, start + len(g))
        start += len(g)
    return column, order


def reading_order(items: DataFrame, id_col: str = "line_no", by_x: bool = True) -> DataFrame:
    """items with column_no and reading_order (from 0 on each page). Duplicate lines keep their places.

    A page's rows travel as one array; only their boxes are looked at in Python, the rest passes through in Arrow's memory.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, column, order = b.column(2), [], []
            values, at = lists.values, lists.offsets.to_numpy()
            boxes = [values.field(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", "_w", "_h")]
            for s, e in zip(at[:-1], at[1:]):
                c, o = order_of(*(v[s:e] for v in boxes), np.arange(e - s), by_x)
                column.append(c)
                order.append(o)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(column, pa.list_(pa.int32())), pa.array(order, pa.list_(pa.int32()))], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    boxes = [F.col(c).cast("double").alias(f"_{c}") for c in "xywh"]
    rest = [c for c in items.columns if c not in PAGE]
    packed = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("_id"), *boxes, F.struct(*rest).alias("_row")))).alias("items"))
    shape = packed.withColumn("column_no", F.expr("cast(array() as array<int>)")).withColumn("reading_order", F.expr("cast(array() as array<int>)")).schema
    target = to_arrow_schema(shape)
    flat = packed.mapInArrow(solve, shape).select(*PAGE, F.explode(F.arrays_zip("items", "column_no", "reading_order")).alias("_z"))
    return flat.select(*PAGE, *[F.col("_z.items._row")[c].alias(c) for c in rest], F.col("_z.column_no").alias("column_no"), F.col("_z.reading_order").alias("reading_order"))
