"""Helpers shared by the corpus operators: hashing of words and n-grams in numpy, and the shared working folder."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Entries that a worker's memo of words may hold.
MEMO_LIMIT = 300_000
#: The largest Bloom filter has two to the power of it bits (16 MB).
BLOOM_BITS = 27


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; none for null."""
    return WORD.findall(text.lower()) if text else []


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES, _PLACES = (_rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 1024))
_WORD_BYTES = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_VISIBLE = np.array([c > 32 and not 28 <= c <= 31 for c in range(256)])
#: Beyond ASCII, characters that don't belong to words: general and CJK punctuation, signs of Latin-1, symbols, no-break and wide spaces.
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def word_hashes(texts: list[str | None], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' words, offsets): text k's words are those from offsets[k] to offsets[k + 1].

    Words are lower-case runs of letters, digits and underscores (of non-ASCII characters, all but the usual marks and signs);
    with exact, they are what white space (ASCII's) separates, as it is.
    """
    if exact:
        parts = [(t or "").encode() for t in texts]
    else:
        lower = [(t or "").lower() for t in texts]
        parts = [(t if t.isascii() else _MARKS.sub(" ", t)).encode() for t in lower]
    a = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = (_VISIBLE if exact else _WORD_BYTES)[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.r_[0, edge]
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    first = np.cumsum(np.array([0, *(len(p) + 1 for p in parts)]))
    offsets = np.searchsorted(starts, first)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    begin = np.cumsum(lengths) - lengths
    letters = a[inside]
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(begin.astype(np.int32), lengths)
    value = _BYTES[letters] * _PLACES[place & 1023]
    if lengths.max() > 1024:  # each stretch of a very long word counts in another way
        value = np.where(place < 1024, value, mix(value + (place >> 10).astype(np.uint64)))
    return mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64)), offsets


def each(texts: list[str | None], exact: bool = False, budget: int = 400_000) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn, worked out for about budget characters at a time."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= budget or k == len(texts) - 1:
            h, o = word_hashes(texts[start : k + 1], exact)
            for x in range(k + 1 - start):
                yield h[o[x] : o[x + 1]]
            start, size = k + 1, 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; one hash of all words if there are fewer than n, none if there are none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD6E8FEB86659FD93


def prefix_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, inverse powers): the hash of h[a:b] is (P[b] - P[a]) * inverse[a], modulo 2**64."""
    if len(_powers[0]) <= len(h):
        n = max(1 << 16, 2 * len(h))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers[0][: len(h)], out=total[1:])
    return total, _powers[1]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the session names in spark.checkpoint.dir; one of our own only in local mode, where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafgrid-"))


def materialise(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut; a lost executor doesn't lose it.

    Shuffle files go when the driver collects what refers to them; a collection is asked for first, so that those of earlier steps don't pile up on the disks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def drawn(df: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """At most n of df's total rows, those of the smallest hashes of all columns; rows alike count once."""
    h = F.xxhash64(*(F.col(c) for c in df.columns), F.lit(seed))
    steps, kept = 1_000_003, df.columns
    out = df.withColumn("\x01h", h)
    if total > 2 * n + 1000:  # a cut that leaves more than n, so that few rows are ranked
        out = out.filter(F.pmod("\x01h", F.lit(steps)) < int(steps * (1.3 * n + 200) / total) + 1)
    out = out.groupBy("\x01h").agg(*(F.first(c).alias(c) for c in kept))
    return out.orderBy(F.pmod("\x01h", F.lit(steps)), "\x01h").limit(n).select(*kept)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit for each hash in the column h of n rows: about 16 bits a row, 2**BLOOM_BITS at most."""
    bits = min(BLOOM_BITS, max(16, (16 * n - 1).bit_length()))

    def fill(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << bits - 6, np.uint8)
        out[table.column("place").to_numpy() & (1 << bits - 6) - 1] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    placed = hashes.select(F.expr(f"h & {(1 << bits) - 1}").alias("place")).distinct().withColumn("part", F.expr(f"place >> {bits - 6}").cast("int"))
    out = np.zeros((64, 1 << bits - 9), np.uint8)
    for r in placed.groupBy("part").applyInArrow(fill, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def likely(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of docs whose doc_id is one of those in wanted (about n), and some others, before a join that drops these: few texts need be moved."""
    known = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.xxhash64("doc_id").alias("h")), n))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for b in batches:
            at = b.column(2).to_numpy() & len(bits) * 8 - 1
            keep = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).filter("doc_id is not null").mapInArrow(choose, f"doc_id {id_type(docs)}, text string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
