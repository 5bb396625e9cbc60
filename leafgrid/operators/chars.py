"""Text lines from positioned characters (doc_id, page_no, char_no, ch, left, top, right, bottom, size) on pages of width and height."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

_CJK = re.compile("[⺀-鿿豈-﫿＀-￯]")
_BLANK = np.array([chr(k).isspace() for k in range(0x3002)])


def visible(chars: DataFrame) -> DataFrame:
    """Without white space and boxes that have no area."""
    return chars.filter(~t.is_blank(F.col("ch")) & (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))


def rows_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices from the top and left, the row of each): a character joins the latest row that it overlaps by more than half of the lower height.

    c: columns left, top, right, bottom. Rows grow; the search ends at a row that lies wholly above. Neighbours of the same top and bottom
    share a row, as it covers them once the first is in; so each such run is looked up once.
    """
    at = np.lexsort((c[:, 0], c[:, 1]))
    tops, bottoms = c[at, 1], c[at, 3]
    first = np.flatnonzero(np.r_[True, (tops[1:] != tops[:-1]) | (bottoms[1:] != bottoms[:-1])][: len(at)])
    rows: list[list[float]] = []
    found = []
    for top, bottom in zip(tops[first].tolist(), bottoms[first].tolist()):
        for k in range(len(rows) - 1, -1, -1):
            row = rows[k]
            if min(row[1], bottom) - max(row[0], top) > 0.5 * min(bottom - top, row[1] - row[0]):
                row[0], row[1] = min(row[0], top), max(row[1], bottom)
                found.append(k)
                break
            if row[1] < top:
                rows.append([top, bottom])
                found.append(len(rows) - 1)
                break
        else:
            rows.append([top, bottom])
            found.append(len(rows) - 1)
    return at, np.repeat(np.array(found, np.int64), np.diff(np.r_[first, len(at)]))


def upper_medians(v: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """sorted[n // 2] of each of n groups (numbers that never fall); NaN for one without values."""
    count = np.bincount(group, minlength=n)
    out = np.full(n, np.nan)
    if len(v) and (v == v[0]).all():
        out[count > 0] = v[0]
    else:
        out[count > 0] = v[np.lexsort((v, group))][(np.cumsum(count) - count + count // 2)[count > 0]]
    return out


def code_points(chars: list[str]) -> np.ndarray | None:
    """One number for each character; None where one has several code points, as ligatures do."""
    joined = "".join(chars)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) if len(joined) == len(chars) and all(chars) else None


def kinds_of(chars: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each character is Chinese, Japanese or full-width; whether it is an ASCII digit)."""
    u = code_points(chars)
    if u is None:
        return np.array([bool(_CJK.match(x)) for x in chars], bool), np.array([x in "0123456789" for x in chars], bool)
    return (u >= 0x2E80) & (u <= 0x9FFF) | (u >= 0xF900) & (u <= 0xFAFF) | (u >= 0xFF00) & (u <= 0xFFEF), (u >= 48) & (u <= 57)


def lines_of_page(c: np.ndarray, chars: list[str], sizes: np.ndarray, width: float, height: float) -> list[tuple]:
    """Rows are cut where the gap exceeds 1.5 median heights and 2 % of the page; western words that are apart get spaces. All rows of a page are worked on at once."""
    if not len(c):
        return []
    at, row = rows_of(c)
    by_left = np.lexsort((c[at, 0], row))
    at, row = at[by_left], row[by_left]
    left, top, right, bottom = c[at].T
    chars, sizes = [chars[k] for k in at.tolist()], sizes[at]
    median = upper_medians(bottom - top, row, int(row.max()) + 1)[row]

    gap = left[1:] - right[:-1]
    opens = np.r_[True, (row[1:] != row[:-1]) | (gap > np.maximum(1.5 * median[1:], 0.02 * width))]
    start, part = np.flatnonzero(opens), np.cumsum(opens) - 1
    n = len(start)

    cjk, digit = kinds_of(chars)
    count = np.diff(np.r_[start, len(at)])
    spaced = ~((np.add.reduceat(cjk.astype(np.int64), start) >= 0.2 * count) | (count < 2))
    western = ~opens[1:] & ~(cjk[1:] | cjk[:-1])
    em = upper_medians(sizes[sizes > 0], part[sizes > 0], n)
    em = np.where(np.isnan(em), median[start], em)
    apart = western & (gap > 0)
    usual = upper_medians(gap[apart], part[1:][apart], n)
    least = np.where(np.isnan(usual), 0.28 * em, np.minimum(0.28 * em, np.maximum(0.12 * em, 1.8 * usual)))
    for k in np.flatnonzero(spaced[part[1:]] & western & ~(digit[1:] & digit[:-1]) & (gap > least[part[1:]])).tolist():
        chars[k + 1] = " " + chars[k + 1]

    x, y, far, low = np.minimum.reduceat(left, start), np.minimum.reduceat(top, start), np.maximum.reduceat(right, start), np.maximum.reduceat(bottom, start)
    ends = [*start[1:].tolist(), len(at)]
    texts = ["".join(chars[s:e]) for s, e in zip(start.tolist(), ends)]
    out = zip((x / width).tolist(), (y / height).tolist(), ((far - x) / width).tolist(), ((low - y) / height).tolist(), texts)
    return sorted(out, key=lambda r: (r[1], r[0]))


LINES = "doc_id long, page_no int, line_no int, x double, y double, w double, h double, text string"
#: Rows in a batch that goes back; a page's lines aren't divided.
BATCH = 20_000


def _batches(pages: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of LINES from (doc_id, page_no, lines)."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], ["doc_id", "page_no", "line_no", *"xywh", "text"])
    rows: list[tuple] = []
    for doc_id, page_no, lines in pages:
        rows += [(doc_id, page_no, n, *line) for n, line in enumerate(lines)]
        if len(rows) >= BATCH:
            yield made(rows)
            rows = []
    if rows:
        yield made(rows)


def _as_lines(made: DataFrame) -> DataFrame:
    return made.withColumn("conf", F.lit(1.0)).withColumn("source", F.lit("PdfTextLayer")).withColumn("ink", F.lit(None).cast("double"))


def text_lines(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of each page, by y and x; confidence 1, source PdfTextLayer. pages: (doc_id, page_no, width, height).

    A page's characters are columns of numbers in Python, never objects; only one page's characters are strings at a time.
    """

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            lists = b.column(2)
            at = lists.offsets.to_pylist()
            for k, (doc_id, page_no, width, height) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                v = lists.values.slice(at[k], at[k + 1] - at[k])
                c = np.column_stack([v.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("left", "top", "right", "bottom")])
                yield doc_id, page_no, lines_of_page(c, v.field("ch").to_pylist(), np.nan_to_num(v.field("size").to_numpy(zero_copy_only=False).astype(float)), float(width), float(height))

    packed = visible(chars).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("char_no", "ch", "left", "top", "right", "bottom", "size"))).alias("chars"))
    joined = packed.join(pages.select("doc_id", "page_no", "width", "height"), ["doc_id", "page_no"])
    return _as_lines(joined.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), "chars", "width", "height").mapInArrow(lambda b: _batches(solved(b)), LINES))


def decoded_lines(pages: DataFrame, decoder: Callable[[str | bytes], tuple[list[str], np.ndarray, np.ndarray]]) -> DataFrame:
    """As text_lines, of pages (doc_id, page_no, width, height, content) whose characters a decoder gives: (characters, boxes of left, top, right and bottom, sizes).

    A page comes whole out of its decoder, so its characters are no rows and don't travel; one page at a time is in memory.
    """

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            ids, nos, widths, heights = (b.column(c).to_pylist() for c in range(4))
            for k in range(b.num_rows):
                content = b.column(4)[k].as_py()
                if content is not None:
                    found, c, sizes = decoder(content)
                    seen = np.flatnonzero(seen_of(found) & (c[:, 2] > c[:, 0]) & (c[:, 3] > c[:, 1]))
                    yield ids[k], nos[k], lines_of_page(c[seen], [found[j] for j in seen.tolist()], sizes[seen], float(widths[k]), float(heights[k]))

    return _as_lines(pages.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), "width", "height", "content").mapInArrow(lambda b: _batches(solved(b)), LINES))


def seen_of(chars: list[str]) -> np.ndarray:
    """Whether each has something visible; the white space is that of functions.text."""
    u = code_points(chars)
    return ~_BLANK[np.minimum(u, 0x3001)] if u is not None else np.array([bool(x) and not x.isspace() for x in chars], bool)
