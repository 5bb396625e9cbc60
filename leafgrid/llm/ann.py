"""Operator 9: approximate nearest neighbours by inner product, with score-aware (anisotropic) quantisation.

Vectors are quantised in subspaces of two dimensions with 16 centres each (four bits), trained and assigned so that the part of
the residual that is parallel to the vector, which is what changes high inner products, costs more than the rest. A coarse
k-means splits the base into cells; a query visits its best cells by centre, scans the codes there with per-query tables (two
four-bit codes a lookup) and reranks the best of the scan with exact inner products. All rows are indexed; the queries are the rows that
a condition names (in the registered query, those whose id is divisible by 100).

Models are trained on the driver on a bounded sample (``train_rows``). There are about as many cells as the square root of the rows, at any size. Base and
queries meet per cell, both sides in parts of at most about PART vectors, so that neither a hot cell nor a growing table makes a large task.

Defined cases: null vectors, vectors with nulls, NaN or infinite numbers and those of another length than most (of several such lengths the
smallest) are left out; zero vectors have inner product 0 with all; ties go to the smaller vec_id, where the scan is cut as well; a row is no neighbour
of itself but repeated rows (same vector, other id) are neighbours, rows of one vec_id are not; rows with a null vec_id are left out; ids may be
numbers or strings; a table of fewer than k + 1 rows gives what there is; an empty one no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PART = 8192


@dataclass
class Model:
    cells: np.ndarray  # [cells, d]
    books: np.ndarray  # [subspaces, 16, 2]
    ratio: float  # cost of the parallel residual against the orthogonal one

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes [n, subspaces] by coordinate descent on the anisotropic loss."""
        return assign(x, self.books, self.ratio, passes)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def directions(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(len(x), -1, 2)


def assign(x: np.ndarray, books: np.ndarray, ratio: float, passes: int) -> np.ndarray:
    u, y = directions(x), x.reshape(len(x), -1, 2)
    m = y.shape[1]
    codes = np.stack([((y[:, s, None] - books[s][None]) ** 2).sum(2).argmin(1) for s in range(m)], 1)
    part = np.stack([(u[:, s] * (y[:, s] - books[s][codes[:, s]])).sum(1) for s in range(m)], 1)
    rho = part.sum(1)
    for _ in range(passes):
        for s in range(m):
            r = y[:, s, None] - books[s][None]
            along = (u[:, s, None] * r).sum(2)
            cost = (r * r).sum(2) + (ratio - 1) * (along + (rho - part[:, s])[:, None]) ** 2
            codes[:, s] = cost.argmin(1)
            new = np.take_along_axis(along, codes[:, s, None], 1)[:, 0]
            rho += new - part[:, s]
            part[:, s] = new
    return codes.astype(np.uint8)


def train(x: np.ndarray, n_cells: int, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Model:
    """Cells by k-means; code books by alternating assignment and the weighted least squares that the anisotropic loss gives."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    ratio = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    u, y = directions(x), x.reshape(len(x), -1, 2)
    m = y.shape[1]
    books = np.stack([kmeans(y[:, s], 16, 8, rng) if len(x) >= 16 else np.resize(y[:, s], (16, 2)) for s in range(m)])
    for _ in range(rounds):
        codes = assign(x, books, ratio, 1)
        part = np.stack([(u[:, s] * (y[:, s] - books[s][codes[:, s]])).sum(1) for s in range(m)], 1)
        rho = part.sum(1)
        for s in range(m):
            other = rho - part[:, s]
            outer = u[:, s, :, None] * u[:, s, None, :]
            for c in range(16):
                of = codes[:, s] == c
                if of.any():
                    left = of.sum() * np.eye(2) + (ratio - 1) * outer[of].sum(0)
                    right = y[of, s].sum(0) + (ratio - 1) * (u[of, s] * (other[of] + (u[of, s] * y[of, s]).sum(1))[:, None]).sum(0)
                    books[s, c] = np.linalg.solve(left, right)
            new = (u[:, s] * (y[:, s] - books[s][codes[:, s]])).sum(1)
            rho += new - part[:, s]
            part[:, s] = new
    return Model(kmeans(x, n_cells, 8, rng).astype(np.float32), books.astype(np.float32), ratio)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, [subspaces / 2, n]."""
    if codes.shape[1] % 2:
        codes = np.c_[codes, np.zeros(len(codes), np.uint8)]
    return np.ascontiguousarray((codes[:, ::2] << 4 | codes[:, 1::2]).T)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per query and byte of code, the part of the inner product: [queries, subspaces / 2, 256]."""
    t = np.einsum("qsd,scd->qsc", q.reshape(len(q), -1, 2), books)
    if t.shape[1] % 2:
        t = np.concatenate([t, np.zeros((len(q), 1, 16), t.dtype)], 1)
    return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query with all codes."""
    out = table[0][codes[0]]
    for t, c in zip(table[1:], codes[1:]):
        out += t[c]
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def neighbours(vectors: DataFrame, k: int = 10, asking: str = "true", probe_share: float = 0.85, rerank: int = 80, train_rows: int = 10_000) -> DataFrame:
    """(vec_id, neighbour_id, score, rank): the k rows of highest inner product for each row that meets the condition ``asking``.

    probe_share: of the cells that a query visits; rerank: candidates of each part of a cell that are rescored exactly, with all that tie with the last.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    sound = "vec_id is not null and v is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = float('infinity'))"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), F.expr(asking).alias("asks")).filter(sound)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"vec_id {kind}, neighbour_id {kind}, score double, rank int"
    if width is None:
        return spark.createDataFrame([], schema)
    d, total = width["d"], width["count"]
    rows = rows.filter(F.size("v") == d)
    x = np.array(sorted(tuple(r.v) for r in common.drawn(rows.select("vec_id", "v"), train_rows, total, 4).collect()), np.float32)
    if d % 2:
        x = np.c_[x, np.zeros(len(x), np.float32)]
    model = spark.sparkContext.broadcast(train(x, max(1, min(len(x) // 4, int(total**0.5)))))  # at most train_rows / 4 cells
    n_probe = max(1, int(np.ceil(len(model.value.cells) * probe_share)))

    def matrix(column: pa.Array) -> np.ndarray:
        v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, d)
        return np.c_[v, np.zeros(len(v), np.float32)] if d % 2 else v

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            v = matrix(b.column(1))
            if len(v):
                cell = (v @ m.cells.T - 0.5 * (m.cells * m.cells).sum(1)).argmax(1).astype(np.int32)
                codes = m.encode(v)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary())], ["cell", "vec_id", "v", "code"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            v = matrix(b.column(1))
            if len(v):
                order = np.argsort(-(v @ m.cells.T), 1, kind="stable")[:, :n_probe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "v", "cells"])

    based = common.materialise(rows.mapInArrow(base, f"cell int, vec_id {kind}, v binary, code binary"))
    parts = based.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.col("parts"))
    left = based.join(parts, "cell").select(F.xxhash64("cell", part(5).cast("int")).alias("at"), "vec_id", "v", "code")
    asks = rows.filter("asks")
    visits = asks.mapInArrow(asked, f"vec_id {kind}, v binary, cells array<int>").select("vec_id", "v", F.explode("cells").alias("cell"))
    visits = visits.join(parts, "cell").select("vec_id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("cell", p))).alias("at"))
    # queries of a place in portions of about PART as well: each meets the whole part of the base
    portions = max(1, int(asks.count() * probe_share // PART))
    left = left.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    visits = visits.select(F.col("at").alias("q_at"), F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(portions)).cast("int").alias("q_portion"), "vec_id", "v")

    def meet(b: pa.Table, q: pa.Table) -> pa.Table:
        id_kind, empty = b.schema.field("vec_id").type, np.zeros(0, int)
        out = [[], [], []]
        if b.num_rows and q.num_rows:
            stack = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
            bid, qid = (np.array(t.column("vec_id").to_pylist()) for t in (b, q))
            bv, qv, codes = stack(b, "v", np.float32), stack(q, "v", np.float32), packed(stack(b, "code", np.uint8))
            for s in range(0, len(qid), 256):
                for i, table in enumerate(tables(qv[s : s + 256], model.value.books), s):
                    score = scan(table, codes)
                    cut = np.partition(score, len(score) - rerank)[len(score) - rerank] if rerank < len(score) else -np.inf
                    near = np.flatnonzero(score >= cut)
                    near = near[bid[near] != qid[i]]
                    exact = (bv[near] @ qv[i]).astype(np.float64)
                    top = best(exact, bid[near], k)
                    out[0].append(np.full(len(top), qid[i]))
                    out[1].append(bid[near][top])
                    out[2].append(exact[top])
        cols = [np.concatenate(v) if v else empty for v in out]
        return pa.table([pa.array(cols[0].tolist(), id_kind), pa.array(cols[1].tolist(), id_kind), pa.array(cols[2], pa.float64())], ["vec_id", "neighbour_id", "score"])

    met = left.groupBy("at", "portion").cogroup(visits.groupBy("q_at", "q_portion")).applyInArrow(meet, f"vec_id {kind}, neighbour_id {kind}, score double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")
    return met.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).dropDuplicates(["vec_id", "rank"])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 asks all rows."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asking="vec_id % 100 = 0")
