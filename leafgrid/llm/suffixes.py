"""Operator 3: repeated passages by bucket-pointer refinement of suffixes.

Suffixes start at words. Initial buckets hold suffixes that agree in ``Q`` words. A bucket of suffixes that agree in n words is refined by
the identifiers of the buckets at a later offset: those at s and s + n name the bucket of s for 2 * n words, and so on, until ``min_words`` are
reached. Every update of an identifier is used again by all suffixes that point there, on the next level. An identifier is the hash of
what it stands for rather than a rank, so one made at one place is the same everywhere and no level needs a pass over the
corpus; the buckets are brought together by sorting on identifiers (in the joins below). A passage is repeated where a bucket of the last level holds two suffixes.

Not every suffix needs a bucket of its own. Suffixes are sampled by winnowing: in each run of min_words words, the q-gram of
the smallest hash is an anchor, the same one wherever the run occurs, so any two copies of a passage share an anchor. Anchors
alone in their bucket end there. Anchors that agree in all words that a passage around them could hold are repeated with
all of it; only the others (the ends of repeated passages) are refined suffix by suffix.

Buckets are counted before rows meet: a line that a third of all documents hold is a number by the time it is shuffled, and the joins
that look the numbers up have one row a bucket on that side, so that Spark may cut a hot bucket's rows into several tasks.

Defined cases: words are separated by white space and compared exactly (text without blanks is one word); passages don't cross documents but may
repeat within one, also overlapping themselves; null and empty texts and those of fewer than min_words words hold none; texts of any length are read whole, a document
being one task's; of equal hashes in a run the first is the anchor; null doc_ids are left out; doc_ids may be of any type; repeated rows
repeat each other; empty tables give no rows; other columns aren't read. min_words may be any number from 1 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

Q = 16


def named(h: np.ndarray, words: int) -> np.ndarray:
    """Level 1: the bucket of the given number of words from each position."""
    total, inverse = common.prefix_hash(h)
    n = len(h) - words + 1
    return common.mix((total[words:] - total[:n]) * inverse[:n] + np.uint64(words)) if n > 0 else np.zeros(0, np.uint64)


def refined(bucket: np.ndarray, offset: int, level: int) -> np.ndarray:
    """The next level: a bucket and the one that the suffix at the offset points to."""
    n = len(bucket) - offset
    return common.mix(common.mix(bucket[:n] + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + bucket[offset:]) if n > 0 else np.zeros(0, np.uint64)


def last_level(h: np.ndarray, min_words: int) -> np.ndarray:
    """The bucket of min_words words from each position, level by level."""
    length = min(Q, min_words)
    bucket, level = named(h, length), 2
    while length < min_words:
        offset = min(length, min_words - length)
        bucket = refined(bucket, offset, level)
        length, level = length + offset, level + 1
    return bucket


def anchors(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, buckets, contexts) of the sampled suffixes."""
    if len(h) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    q = min(Q, min_words)
    bucket, width = named(h, q), min_words - q + 1
    at = np.unique(np.lib.stride_tricks.sliding_window_view(bucket, width).argmin(1) + np.arange(len(bucket) - width + 1))
    total, inverse = common.prefix_hash(h)
    start, end = np.maximum(0, at - width + 1), np.minimum(len(h), at + min_words)
    context = common.mix((total[end] - total[start]) * inverse[start])
    return at, bucket[at], common.mix(context + (at - start).astype(np.uint64) * np.uint64(1 << 32) + (end - at).astype(np.uint64))


def batch(ids: pa.Array, rows: list[tuple[int, tuple]], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of doc_id and the columns of rows: (place of the document, columns)."""
    place = np.repeat([k for k, _ in rows], [len(c[0]) for _, c in rows]).astype(np.int64)
    columns = [pa.array(np.concatenate([c[x] for _, c in rows]) if rows else [], kind) for x, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(place)), *columns], ["doc_id", *kinds])


def shared(rows: DataFrame, by: str) -> DataFrame:
    """The rows that share their value in a column with another one."""
    several = rows.groupBy(by).agg(F.count("*").alias("_n")).filter("_n > 1").select(by)
    return rows.join(several, by, "left_semi")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal stretches whose every word lies in a repeated passage of at least min_words words."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    kind = common.id_type(docs)
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    before = min_words - min(Q, min_words)  # how far before its anchor a passage may begin

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bucket": pa.int64(), "context": pa.int64(), "at": pa.int32(), "n": pa.int32()}
        for b in batches:
            rows = []
            for k, h in enumerate(common.each(b.column(1).to_pylist(), exact=True)):
                at, bucket, context = anchors(h, min_words)
                if len(at):
                    rows.append((k, (bucket.view(np.int64), context.view(np.int64), at.astype(np.int32), np.full(len(at), len(h), np.int32))))
            yield batch(b.column(0), rows, kinds)

    sampled = common.materialise(docs.mapInArrow(sample, f"doc_id {kind}, bucket long, context long, at int, n int"))
    found = common.materialise(shared(sampled, "bucket"))
    alike = common.materialise(found.groupBy("bucket", "context").agg(F.count("*").alias("alike"), F.min(F.struct("doc_id", "at")).alias("first")))
    certain = found.join(alike.filter("alike > 1"), ["bucket", "context"], "left_semi").select("doc_id", F.greatest(F.lit(0), F.col("at") - before).alias("start"), F.least("n", F.col("at") + min_words).alias("end"))
    # where an anchor of a bucket agrees with no other in all words around, one of each context is looked at in detail
    mixed = alike.filter("alike = 1").select("bucket").distinct()
    undecided = common.materialise(alike.join(mixed, "bucket", "left_semi").select("first.*").groupBy("doc_id").agg(F.collect_list("at").alias("places")))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (h, places) in enumerate(zip(common.each(b.column(1).to_pylist(), exact=True), b.column(2).to_pylist())):
                bucket = last_level(h, min_words)
                wanted = np.unique((np.asarray(places)[:, None] - np.arange(before + 1)).ravel())
                wanted = wanted[(wanted >= 0) & (wanted < len(bucket))]
                rows.append((k, (bucket[wanted].view(np.int64), wanted.astype(np.int32))))
            yield batch(b.column(0), rows, {"bucket": pa.int64(), "start": pa.int32()})

    texts = common.likely(docs, undecided, undecided.count()).join(undecided, "doc_id").select("doc_id", "text", "places")
    suffixes = common.materialise(texts.mapInArrow(refine, f"doc_id {kind}, bucket long, start int"))
    again = shared(suffixes, "bucket").select("doc_id", "start", (F.col("start") + min_words).cast("int").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = certain.unionByName(again).distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("span")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.documents(spark, sf_dir))
