"""Operator 4: benchmark decontamination by greedy string tiling.

Seeds (runs of ``min_match`` tokens of a test item, Karp-Rabin hashed) are joined with the documents' runs; for every pair
that shares enough of them, the longest non-overlapping matches are marked again and again until none of ``min_match`` tokens is
left, and the share of the test item's tokens under marks is held against ``coverage``. Tiles may lie anywhere in the
document, so reordered passages count in full.

The documents are read once and never shuffled. The test items travel to the executors in blocks of at most ``block_bytes`` of
text: one block for a benchmark of usual size, several (each a further pass over the documents) for a larger one.

Defined cases: null or empty texts and items match nothing; items shorter than ``min_match`` count if they occur as a whole (a benchmark of single words
would mark each text that has one: leave such items out); text without blanks, as in Chinese or Japanese, is one word; texts of any length are read whole; of equally long matches
the one that starts first in the item goes first, then in the document; a share equal to coverage counts; doc_ids may be of any type, item_ids are
whole numbers or are written as strings; rows with a null doc_id or item_id are reported with that null; repeated rows are each reported; empty tables give no rows;
other columns aren't read by ``contaminated`` and pass through ``keep_clean``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tiles(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiling, longest first; ties by the earliest start in the item, then the document.

    seeds: all (i, j) where k tokens agree. Runs of seeds on a diagonal are the maximal matches; one that overlaps marked
    tokens is cut to its free parts, which compete again.
    """
    by_diagonal = defaultdict(list)
    for i, j in seeds:
        by_diagonal[j - i].append(i)
    heap = []
    for d, starts in by_diagonal.items():
        starts.sort()
        first = last = starts[0]
        for i in [*starts[1:], None]:
            if i is None or i > last + 1:
                heap.append((-(last - first + k), first, first + d))
                first = i
            last = i
    heapq.heapify(heap)
    marked_item, marked_doc, out = np.zeros(len(item), bool), set(), []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = [not marked_item[i + x] and j + x not in marked_doc for x in range(length)]
        if all(free):
            out.append((i, j, length))
            marked_item[i : i + length] = True
            marked_doc.update(range(j, j + length))
            continue
        start = None
        for x, ok in enumerate([*free, False]):
            if ok and start is None:
                start = x
            elif not ok and start is not None:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, i + start, j + start))
                start = None
    return out


class Block:
    """The seeds of some test items, sorted for lookup."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.items = [(i, h) for (i, _), h in zip(rows, common.each([t for _, t in rows]))]
        self.seeds = {}
        by_length = defaultdict(list)
        for k, (_, h) in enumerate(self.items):
            if len(h):
                by_length[min(min_match, len(h))].append(k)
        for n, owners in by_length.items():
            grams = [common.ngrams(self.items[k][1], n) for k in owners]
            flat = np.concatenate(grams)
            owner = np.repeat(owners, [len(g) for g in grams])
            at = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(flat, kind="stable")
            self.seeds[n] = (flat[order], owner[order], at[order])

    def found(self, h: np.ndarray, coverage: float) -> list[tuple]:
        """(item id, coverage, tiles, longest) of the items that the text of these word hashes holds."""
        out = []
        for n, (flat, owner, at) in self.seeds.items():
            if len(h) < n:
                continue
            g = common.ngrams(h, n)
            lo = np.searchsorted(flat, g)
            hit = np.flatnonzero(flat[np.minimum(lo, len(flat) - 1)] == g)
            if not len(hit):
                continue
            first, times = lo[hit], np.searchsorted(flat, g[hit], "right") - lo[hit]
            which = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            own, i, j = owner[which], at[which], np.repeat(hit, times)
            order = np.lexsort((j, i, own))
            own, i, j = own[order], i[order], j[order]
            # tiles consist of seeds: of each item no more words than its seeds cover can be tiled
            same = own[1:] == own[:-1]
            covered = np.r_[np.where(same, np.minimum(i[1:] - i[:-1], n), n), n]
            start = np.flatnonzero(np.r_[True, ~same])
            for s, e, c in zip(start, np.r_[start[1:], len(own)], np.add.reduceat(covered, start)):
                k = own[s]
                item = self.items[k][1]
                if c < coverage * len(item):
                    continue
                found = tiles(item, h, list(zip(i[s:e].tolist(), j[s:e].tolist())), n)
                share = sum(x[2] for x in found) / len(item)
                if share >= coverage:
                    out.append((self.items[k][0], share, len(found), found[0][2]))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


def blocks(bench: DataFrame, min_match: int, block_bytes: int) -> Iterator[Block]:
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        number = bench.schema["item_id"].dataType.typeName() in ("long", "integer", "short", "byte")
        part = bench.select("item_id" if number else F.col("item_id").cast("string").alias("item_id"), "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Block([tuple(r) for r in part.collect()], min_match)


def contaminated(docs: DataFrame, bench: DataFrame, coverage: float = 0.5, min_match: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of each document and test item of which it holds at least that share."""
    out = None
    for block in blocks(bench, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(i, *x) for i, h in zip(ids, common.each(b.column(1).to_pylist())) for x in shared.value.found(h, coverage)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((b.schema.field(0).type, item_type, pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "coverage", "tiles", "longest"])

        item_type = pa.int64() if bench.schema["item_id"].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
        found = docs.select("doc_id", "text").mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {'long' if item_type == pa.int64() else 'string'}, coverage double, tiles int, longest int")
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, bench: DataFrame, coverage: float = 0.5, min_match: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item."""
    at, schema = docs.columns.index("text"), docs.schema
    for block in blocks(bench, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.found(h, coverage) for h in common.each(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(choose, schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
