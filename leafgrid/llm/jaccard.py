"""Operator 6: n-gram Jaccard self-join with rare-first prefix filtering, length, positional and suffix filters.

A document is the set of its word n-grams (64-bit hashes). Sets are put in one global order, rare n-grams first; two sets of
Jaccard similarity t or more share an n-gram among the first m - ceil(t * m) + 1 of each. The order comes from a frequency
sketch over all documents (a table of counters whose size is bounded): any global order gives exact
results, a good one few candidates.

1. Every task counts n-grams into the sketch and emits each document's set fingerprint.
2. Prefix postings leave the tasks packed as one row per batch and hash bucket, and meet in their bucket, where the length
   filter and the positional filter cut the pairs that share an n-gram. A pair is taken where its sets don't share the
   n-gram before, which holds for the first one that they share, so it leaves few buckets. Equal sets have one fingerprint and count as one.
3. A pair goes to the cell of its smallest such n-gram; cells that hold many sets are divided into blocks of sets, so that the hottest
   one is verified by many tasks. The suffix filter (digests: counts per hash range) and then the full sets decide, once per pair.

4. What leaves the verification is linear in the sets that it holds: each set's number of partners (copies counted) and the edges of a
spanning forest of the cell's pairs. Only ``pairs`` lets the pairs themselves out.

Number of buckets follows the number of postings, number of counters the number of documents (2**24 at most, 16 MB of levels; beyond some hundred million documents give a larger
``bits``, as rare n-grams can't be told apart otherwise and more pairs are looked at). Texts are sent
to verification after a Bloom filter of the documents that have a candidate left; its size follows their number up to ``common.BLOOM_BITS``, beyond
which it lets more of the others through, which a join then drops.

Results: ``classes`` gives (doc_id, class_id, n_links), one row for each document that has a link: class_id is the smallest doc_id that a chain of links leads
to, n_links the number of other documents of similarity t or more, copies among them. ``pairs`` gives (doc_a, doc_b, jaccard) with
doc_a < doc_b: one row for each pair of distinct sets, between their smallest doc_ids, and one row of similarity 1 that ties each
further document of the same set to that smallest doc_id.

Defined cases: texts without words (null and empty among them) have no set and match nothing; a text of fewer than n words is one
n-gram; text between blanks that has no marks, as in Chinese or Japanese, is one word; a text of any length is one set, held whole by the tasks that need it;
similarity exactly t is a link; null doc_ids are left out; doc_ids may be of any type that can be ordered; a repeated doc_id is joined by its first set in order of the
fingerprint and rows of one doc_id are no pair; empty tables give no rows; other columns aren't read and pass through ``keep_one``.
N-grams are the same if their 64-bit hashes are; two sets whose first common n-gram is preceded by different ones equal in 32 bits miss each other there (once in 4e9 pairs).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SKETCH_BITS, SLICE_BITS, COUNTERS = 24, 14, 64
#: Postings that a bucket is to hold, pairs of a cell, pairs and sets of a group of cells.
BUCKET_POSTINGS, CELL_PAIRS, GROUP_PAIRS, GROUP_SETS = 700_000, 4000, 40_000, 256
#: Documents handled at a time within an Arrow batch.
STEP = 1000


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Each text's set of n-grams, sorted."""
    for h in common.each(texts):
        g = np.sort(common.ngrams(h, n))
        yield g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g


def fingerprint(grams: np.ndarray) -> int:
    """64 bits of the whole set, as a signed number."""
    return int(common.mix(grams + np.uint64(len(grams))).sum(dtype=np.uint64).astype(np.int64)) if len(grams) else 0


def digest(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each of 2**k equal ranges of the hash space, two to four on average, in three bits each, 7 for more."""
    k = max(1, (len(grams) - 1).bit_length() - 2)
    n = np.minimum(np.bincount((grams >> np.uint64(64 - k)).astype(np.int32), minlength=1 << k), 7)
    return np.packbits((n[:, None] >> np.arange(3) & 1).astype(np.uint8)).tobytes()


def counts(digests: list[bytes]) -> np.ndarray:
    """Digests of one length as rows of counts."""
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1), axis=1)
    ranges = 1 << (bits.shape[1] // 3).bit_length() - 1
    return bits[:, : 3 * ranges].reshape(len(digests), ranges, 3) @ np.array([1, 2, 4], np.uint8)


def digest_bounds(a: np.ndarray, b: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For rows of counts, at least the overlap of sets of m and k n-grams: what each range of the hash space can share, and what lies above the counts (the suffix filter)."""
    x, y = a.astype(np.int32), b.astype(np.int32)
    over = np.minimum(m - x.sum(1), k - y.sum(1))
    width = min(x.shape[1], y.shape[1])
    x, y = (v if v.shape[1] == width else v.reshape(len(v), width, -1).sum(2) for v in (x, y))
    return np.minimum(x, y).sum(1) + over


def prefix_length(m: int, t: float) -> int:
    return m - int(np.ceil(t * m - 1e-9)) + 1


def needed(a, b, t: float):
    """The overlap that sets of these sizes need."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def sketch_bits(docs: DataFrame) -> int:
    """Two to the power of it is the number of counters: COUNTERS a document, from 2**20 to 2**SKETCH_BITS."""
    return min(SKETCH_BITS, max(20, (COUNTERS * docs.count() - 1).bit_length()))


def packed(counters: np.ndarray) -> bytes:
    """Which counters aren't zero, a bit each, and these ones' values, a plane for each of their four bytes."""
    used = counters > 0
    planes = counters[used].astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.packbits(used).tobytes() + planes.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(x), np.uint8)
    out = np.zeros(1 << SLICE_BITS, np.uint64)
    out[np.unpackbits(raw[: 1 << SLICE_BITS - 3]).astype(bool)] = np.ascontiguousarray(raw[1 << SLICE_BITS - 3 :].reshape(4, -1).T).view("<u4").ravel()
    return out


def survey(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (doc_id, fp, m, digest) for documents, and (slice, counts) of the sketch for each task."""
    slices = 1 << bits - SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            ids, texts = b.column(0).to_pylist(), b.column(1)
            keep, fps, ms, digests = [], [], [], []
            for s in range(0, len(ids), STEP):
                waiting = []
                for i, g in zip(ids[s : s + STEP], gram_sets(texts.slice(s, STEP).to_pylist(), n)):
                    if len(g) and i is not None:
                        waiting.append((g >> np.uint64(64 - bits)).astype(np.int32))
                        keep.append(i)
                        fps.append(fingerprint(g))
                        ms.append(len(g))
                        digests.append(digest(g))
                if waiting:
                    at, times = np.unique(np.concatenate(waiting), return_counts=True)
                    sketch[at] += times.astype(np.uint32)
            k = len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(keep, kind), pa.array(fps, pa.int64()), pa.array(ms, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if sketch.any():
            parts = [packed(x) for x in np.split(sketch, slices)]
            yield pa.RecordBatch.from_arrays([pa.nulls(slices, kind), pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.int32()), pa.nulls(slices, pa.binary()), pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "fp", "m", "digest", "slice", "counts"]
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {common.id_type(docs)}, fp long, m int, digest binary, slice int, counts binary")


def sketch_of(surveyed: DataFrame, bits: int) -> np.ndarray:
    """The tasks' sketches summed, as levels of the logarithm: at most 2**SKETCH_BITS bytes come to the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(map(unpacked, table.column("counts").to_pylist()))
        level = np.minimum(np.rint(12 * np.log2(1.0 + total)), 255).astype(np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([level.tobytes()], pa.binary())})

    rows = surveyed.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["counts"], np.uint8)
    return out


def short(x: np.ndarray) -> np.ndarray:
    """In two bytes each, if they fit."""
    return x.astype(np.uint16) if x.max() < 1 << 16 else x.astype(np.int32)


def long(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.int32 if len(x) == 4 * n else np.uint16).astype(np.int32)


def candidates(docs: DataFrame, sketch: np.ndarray, n_buckets: int, n: int, t: float) -> DataFrame:
    """(a, b, gram): pairs of set fingerprints, a < b, that pass the filters, with a number for the n-gram that they share.

    Within a bucket n-grams go by 32 bits: two that fall together make a candidate more.
    """
    bits = len(sketch).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            for s in range(0, b.num_rows, STEP):
                part, seen = b.slice(s, STEP), set()
                fps, ms, sizes, grams, places, before = [], [], [], [], [], []
                for i, g in zip(part.column(0).to_pylist(), gram_sets(part.column(1).to_pylist(), n)):
                    if not len(g) or i is None or (fp := fingerprint(g)) in seen:
                        continue
                    seen.add(fp)
                    k = prefix_length(len(g), t)
                    count = order[(g >> np.uint64(64 - bits)).astype(np.int32)].astype(np.uint64)
                    rank = np.argsort(count << np.uint64(32) | g & np.uint64(0xFFFFFFFF), kind="stable")[:k]
                    fps.append(fp)
                    ms.append(len(g))
                    sizes.append(k)
                    grams.append(g[rank])
                    places.append(np.arange(k, dtype=np.int32))
                    before.append(np.r_[fp & 0xFFFFFFFF, g[rank[:-1]] & np.uint64(0xFFFFFFFF)].astype(np.uint32))
                if not fps:
                    continue
                gram, place, prev, doc = np.concatenate(grams), np.concatenate(places), np.concatenate(before), np.repeat(np.arange(len(fps), dtype=np.uint16), sizes)
                gram = common.mix(gram)
                bucket, gram = (gram % np.uint64(n_buckets)).astype(np.int32), (gram >> np.uint64(32)).astype(np.uint32)
                place = short(place)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                cols = [[], [], [], [], [], []]
                flat = gram, place, prev, np.array(fps, np.int64)[doc], short(np.array(ms, np.int32))[doc]
                for k in np.flatnonzero(np.diff(cuts)):
                    at = by[cuts[k] : cuts[k + 1]]
                    for c, v in zip(cols, (int(k), *(v[at].tobytes() for v in flat))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, place, prev, fp, m = [], [], [], [], []
        for batch in batches:
            for g, p, v, f, z in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names[1:])):
                gram.append(np.frombuffer(g, np.uint32))
                place.append(long(p, len(g) // 4))
                prev.append(np.frombuffer(v, np.uint32))
                fp.append(np.frombuffer(f, np.int64))
                m.append(long(z, len(g) // 4))
        gram, place, prev, fp, m = map(np.concatenate, (gram, place, prev, fp, m))
        by = np.argsort(gram, kind="stable")
        g = gram[by]
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        again[:-1] |= again[1:]
        by = by[again]
        gram, place, prev, fp, m = gram[by], place[by], prev[by], fp[by], m[by]
        by = np.lexsort((fp, m, gram))
        gram, place, prev, fp, m = gram[by], place[by], prev[by], fp[by], m[by]
        once = np.ones(len(gram), bool)
        once[1:] = (gram[1:] != gram[:-1]) | (fp[1:] != fp[:-1])
        gram, place, prev, fp, m = gram[once], place[once], prev[once], fp[once], m[once]
        ends = np.flatnonzero(np.r_[gram[1:] != gram[:-1], True]) + 1 if len(gram) else np.zeros(0, int)
        end = np.repeat(ends, np.diff(np.r_[0, ends]))
        # the i-th set of each n-gram with the next ones, at growing distance, while any is left and long sets aren't too long
        out, size, live, step = [], 0, np.arange(len(gram)), 1
        while len(live := live[live + step < end[live]]):
            x, y = live, live + step
            near = m[x] >= t * m[y] - 1e-9
            live = live[near]  # sizes grow within an n-gram: none further can be near enough
            x, y = x[near], y[near]
            # the first n-gram that two sets share isn't preceded by the same one, and leaves enough after it in both
            ok = (prev[x] != prev[y]) & (1 + np.minimum(m[x] - place[x] - 1, m[y] - place[y] - 1) >= needed(m[x], m[y], t))
            x, y = x[ok], y[ok]
            if len(x):
                out.append(np.stack([np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]), gram[x].astype(np.int64)]))
                size += len(x)
            if size > 500_000:
                yield least(np.concatenate(out, 1))
                out, size = [], 0
            step += 1
        yield least(np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64))

    def least(x: np.ndarray) -> pa.RecordBatch:
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        first = np.ones(x.shape[1], bool)
        first[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
        return pa.RecordBatch.from_arrays([pa.array(x[0, first]), pa.array(x[1, first]), pa.array(x[2, first].astype(np.uint32).view(np.int32))], ["a", "b", "gram"])

    names = ["bucket", "gram", "place", "prev", "fp", "m"]
    posted = docs.select("doc_id", "text").mapInArrow(post, "bucket int, gram binary, place binary, prev binary, fp binary, m binary")
    met = posted.groupBy("bucket").applyInArrow(meet, "a long, b long, gram int")
    return met.groupBy("a", "b").agg(F.min("gram").alias("gram"))


def with_cells(cand: DataFrame) -> DataFrame:
    """cand with u and v: the pairs of one n-gram share a cell (gram, u, v); those of many pairs are divided into blocks of sets."""
    number = F.count("*").over(Window.partitionBy("gram"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    blocked = cand.withColumn("blocks", F.ceil(F.sqrt(number / CELL_PAIRS)).cast("int"))
    return blocked.select("a", "b", "gram", F.least(block("a"), block("b")).alias("u"), F.greatest(block("a"), block("b")).alias("v"))


def grouped(cells: DataFrame, n_groups: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, gram, u, v, cell), (of_cell, fp)): the pairs by group of cells, and the sets that each group needs."""
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("gram", "u", "v"), F.lit(n_groups))).repartition("cell")
    return cells, cells.select("cell", F.explode(F.array("a", "b")).alias("fp")).distinct().withColumnRenamed("cell", "of_cell")


def suffix_filter(cand: DataFrame, digests: DataFrame, t: float) -> DataFrame:
    """The candidates, with their cells, that their digests allow; digests: (fp, m, digest)."""
    cells, wanted = grouped(with_cells(cand), int(cand.count() // GROUP_PAIRS) + 1)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        fps, ms = (right.column(c).to_numpy() for c in ("fp", "m"))
        by = np.argsort(fps)
        fps, ms = fps[by], ms[by].astype(np.int64)
        digests = right.column("digest").take(pa.array(by)).to_pylist()
        length = np.array([len(d) for d in digests])
        keep = np.zeros(left.num_rows, bool)
        if len(fps):
            place = np.zeros(len(fps), int)  # of each digest among those of its length
            rows = {}
            for size in np.unique(length).tolist():
                of = np.flatnonzero(length == size)
                place[of] = np.arange(len(of))
                rows[size] = counts([digests[k] for k in of])
            a, b = (left.column(c).to_numpy() for c in ("a", "b"))
            x, y = (np.minimum(np.searchsorted(fps, v), len(fps) - 1) for v in (a, b))
            known = (fps[x] == a) & (fps[y] == b)
            kinds = length[x] * (1 << 32) + length[y]
            for kind in np.unique(kinds).tolist():
                of = np.flatnonzero(known & (kinds == kind))
                for s in range(0, len(of), 4096):
                    at = of[s : s + 4096]
                    i, j = x[at], y[at]
                    keep[at] = digest_bounds(rows[kind >> 32][place[i]], rows[kind & 0xFFFFFFFF][place[j]], ms[i], ms[j]) >= needed(ms[i], ms[j], t)
        return left.select(["a", "b", "gram", "u", "v"]).filter(pa.array(keep))

    return cells.groupBy("cell").cogroup(wanted.join(digests, "fp").groupBy("of_cell")).applyInArrow(choose, "a long, b long, gram int, u int, v int")


def verify(cand: DataFrame, docs: DataFrame, reps: DataFrame, n: int, t: float, all_pairs: bool = False) -> DataFrame:
    """Of the candidates that have the similarity; reps: (fp, rep, copies).

    With all_pairs, (a, b, jaccard) of each; else (a, b, links): rows without b tell how many documents a's set is linked to, those with b are a spanning forest.
    """
    n_sets = cand.select("gram", "u", "v", F.explode(F.array("a", "b")).alias("fp")).agg(F.approx_count_distinct(F.struct("gram", "u", "v", "fp"))).first()[0]
    cells, wanted = grouped(cand, int(n_sets // GROUP_SETS) + 1)
    wanted = common.materialise(wanted.join(reps, "fp").select("of_cell", "fp", F.col("rep").alias("doc_id"), "copies"))
    few = common.likely(docs, wanted, n_sets)
    texts = wanted.join(few, "doc_id").select("of_cell", "fp", "doc_id", "copies", "text")
    kind = common.id_type(docs)

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        id_kind = right.schema.field("doc_id").type
        known = {}
        for fp, i, c, g in zip(*(right.column(k).to_pylist() for k in ("fp", "doc_id", "copies")), gram_sets(right.column("text").to_pylist(), n)):
            if fp not in known and fingerprint(g) == fp:
                known[fp] = (i, c, g)
        rows, links, parent = [], {}, {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for x, y in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            if x not in known or y not in known:
                continue  # a further set of a repeated doc_id
            (i, c, a), (j, d, b) = known[x], known[y]
            both = np.concatenate([a, b])
            both.sort(kind="stable")  # two sorted runs
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if shared < needed(len(a), len(b), t):
                continue
            if all_pairs:
                rows.append((min(i, j), max(i, j), shared / (len(a) + len(b) - shared)))
                continue
            links[i], links[j] = links.get(i, 0) + d, links.get(j, 0) + c
            if (u := root(x)) != (v := root(y)):
                parent[u] = v
                rows.append((i, j, None))
        rows += [(i, None, k) for i, k in links.items()]
        last = pa.array([r[2] for r in rows], pa.float64() if all_pairs else pa.int64())
        return pa.table([pa.array([r[0] for r in rows], id_kind), pa.array([r[1] for r in rows], id_kind), last], ["a", "b", "jaccard" if all_pairs else "links"])

    return cells.groupBy("cell").cogroup(texts.groupBy("of_cell")).applyInArrow(decide, f"a {kind}, b {kind}, " + ("jaccard double" if all_pairs else "links long"))


def found(docs: DataFrame, n: int, t: float, all_pairs: bool, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep, copies) of the documents that have a set, what ``verify`` finds)."""
    bits = bits or sketch_bits(docs)
    surveyed = common.materialise(survey(docs, n, bits))
    known = surveyed.filter("slice is null")
    sets = known.groupBy("doc_id").agg(F.min("fp").alias("fp"))
    digests = known.select("fp", "m", "digest").dropDuplicates(["fp"])
    postings = known.agg(F.sum((F.col("m") * (1 - t)).cast("long") + 1)).first()[0] or 0
    reps = common.materialise(sets.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    cand = common.materialise(candidates(docs, sketch_of(surveyed, bits), int(postings // BUCKET_POSTINGS) + 1, n, t))
    cand = common.materialise(suffix_filter(cand, digests, t))
    return sets.join(reps, "fp").select("doc_id", "rep", "copies"), verify(cand, docs, reps, n, t, all_pairs)


def pairs(docs: DataFrame, n: int = 2, t: float = 0.7) -> DataFrame:
    """(doc_a, doc_b, jaccard), see above; a group of k near copies gives k * (k - 1) / 2 rows, where ``classes`` gives k."""
    members, near = found(docs, n, t, True)
    equal = members.filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard").unionByName(equal)


def classes(docs: DataFrame, n: int = 2, t: float = 0.7, bits: int | None = None) -> DataFrame:
    """(doc_id, class_id, n_links), see above."""
    members, near = found(docs, n, t, False, bits)
    near = common.materialise(near)
    linked = near.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(near.filter("b is not null").select("a", "b")).select(F.col("id").alias("rep"), "root")
    out = members.join(linked.join(roots, "rep"), "rep", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return out.filter("n_links > 0").select("doc_id", F.coalesce("root", "rep").alias("class_id"), "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected group of (a, b) edges, for ids that have an edge.

    Large stars and small stars in turn, each pair of them cut off in the shared folder, until every group is one star around its
    smallest id. Rounds grow with the logarithm of a group's size; there is no bound on them.
    """
    start = common.materialise(edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).distinct())
    links = start.filter("id <> root")
    # a link leads from an id to a smaller one; in stars each id has one, and none leads on
    while links.groupBy("id").agg(F.count("*").alias("n")).join(links.select(F.col("root").alias("id"), F.lit(1).alias("on")).distinct(), "id", "left").filter("n > 1 or on = 1").limit(1).count():
        both = links.union(links.select(F.col("root"), F.col("id")))
        least = both.groupBy("id").agg(F.least(F.col("id"), F.min("root")).alias("least"))
        large = both.join(least, "id").filter("root > id").select(F.col("root").alias("id"), F.col("least").alias("root")).distinct()
        least = large.groupBy("id").agg(F.min("root").alias("least"))
        small = large.join(least, "id").select(F.when(F.col("root") > F.col("least"), F.col("root")).otherwise(F.col("id")).alias("id"), F.col("least").alias("root"))
        links = common.materialise(small.union(least.select("id", F.col("least").alias("root"))).distinct())
    alone = start.filter("id = root")
    return links.union(links.select(F.col("root"), F.col("root"))).union(alone).groupBy("id").agg(F.min("root").alias("root"))


def keep_one(docs: DataFrame, n: int = 2, t: float = 0.7, bits: int | None = None) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their group of near duplicates; of repeated rows of one doc_id all stay. Rows with a null doc_id stay."""
    gone = classes(docs, n, t, bits).filter("doc_id <> class_id").select(F.col("doc_id").alias("\x01id"))
    return docs.join(gone, docs["doc_id"] == F.col("\x01id"), "left_anti")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir))
