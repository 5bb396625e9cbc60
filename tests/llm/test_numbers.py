import duckdb
import numpy as np
import pytest

from leafgrid.llm import ann, mixture, queries


def test_schedule_follows_sql(docs, data, spark):
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, data).toPandas(), c.execute(sql).fetchdf()
        cols = sorted(a.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert cols == sorted(b.columns) and a.equals(b), name


def rows(rng, sizes):
    out, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((k, " ".join(["w"] * int(rng.integers(1, 40))), source))
            k += 1
    return out


def test_schedule(docs):
    rng = np.random.default_rng(0)
    data = rows(rng, {"a": 400, "b": 60, "c": 60})
    got = mixture.schedule(docs(data), block_tokens=64).toPandas()
    slots = got.groupby("slot").source.agg(["nunique", "first"])
    assert (slots["nunique"] == 1).all() and slots.index.tolist() == list(range(len(slots)))
    assert set(got.doc_id) == {r[0] for r in data}  # every document has a place
    tokens = got.assign(n=got.end_token - got.start_token).groupby(["slot"]).n.sum()
    assert (tokens <= 64).all() and (tokens == 64).mean() > 0.9
    length = {r[0]: len(r[1].split()) for r in data}
    once = got[got.epoch == 0].assign(n=lambda d: d.end_token - d.start_token).groupby("doc_id").n.sum()
    assert once.to_dict() == length
    share = {s: sum(length[r[0]] for r in data if r[2] == s) ** 0.5 for s in "abc"}
    for upto in (50, 200, len(slots)):
        part = slots["first"][:upto].value_counts(normalize=True)
        for s in "abc":
            assert abs(part.get(s, 0) - share[s] / sum(share.values())) < 6 / upto + 0.01


def test_schedule_weights_and_edges(docs):
    data = [(1, "a b c", "x"), (2, "d e", "y"), (3, None, "x"), (4, "", "y"), (5, "  ", "z"), (None, "f g", None), (6, "h i", "y"), (6, "h i", "y"), (7, "w " * 20_000, "x")]
    got = mixture.schedule(docs(data, extra=("slot", "block", "at")), block_tokens=8).toPandas()
    assert set(got.source) == {"x", "y", None} and {1, 2, 6, 7} <= set(got.doc_id.dropna()) and got.doc_id.isna().any()
    only = mixture.schedule(docs(data), {"y": 1.0, "nowhere": 3.0}, block_tokens=8).toPandas()
    assert set(only.source) == {"y"}
    assert mixture.schedule(docs([])).count() == 0 and mixture.schedule(docs([None, ""])).count() == 0


def test_null_source_beside_the_empty_name(docs):
    data = [(1, "a b", None), (2, "c d", ""), (3, "e f", "n"), (4, "g h", "s")]
    got = mixture.schedule(docs(data), block_tokens=8).toPandas()
    assert {(r.doc_id, r.source) for r in got.itertuples()} == {(1, None), (2, ""), (3, "n"), (4, "s")}
    assert set(mixture.schedule(docs(data), {None: 1.0, "": 0.0}, block_tokens=8).toPandas().doc_id) == {1}


def test_points_of_far_slots_and_their_number(spark):
    far = [0, 1, 5, 3_474_701_534, 5_000_000_000, 10**13]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in far], "id long").select(mixture.points(mixture.F.col("id"))).collect()]
    assert got == [i * mixture.STEP % mixture.RANGE for i in far]
    rng = np.random.default_rng(8)
    p = np.array([i * mixture.STEP % mixture.RANGE for i in range(3000)])
    for _ in range(30):
        low, high = sorted(int(v) for v in rng.integers(0, mixture.RANGE + 1, 2))
        inside = (p >= low) & (p < high)
        n = int(rng.integers(0, 3000))
        assert mixture.drawn(n, low, high) == inside[:n].sum()
        if inside.sum() > 5:
            assert mixture.slots_for(5, low, high) == np.flatnonzero(inside)[4] + 1


def test_blocks_of_many_epochs_are_copied(docs, monkeypatch):
    rng = np.random.default_rng(1)
    df = docs(rows(rng, {"a": 300, "b": 1}))
    want = sorted(mixture.schedule(df, block_tokens=32).collect())
    monkeypatch.setattr(mixture, "EPOCHS", 1)
    assert sorted(mixture.schedule(df, block_tokens=32).collect()) == want and max(r.epoch for r in want) > 3


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, 1, kind="stable")[:, :k]


def test_anisotropic_loss_beats_plain_on_parallel_residual():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.train(x, 1)
    decode = lambda codes: np.concatenate([model.books[s][codes[:, s]] for s in range(8)], 1)
    along = lambda ratio: np.abs(((x - decode(ann.assign(x, model.books, ratio, 2))) * x).sum(1)).mean()
    assert along(8.0) < along(1.0)
    codes = model.encode(x)
    scores = ann.scan(ann.tables(x[:1], model.books)[0], ann.packed(codes))
    assert np.allclose(scores, decode(codes) @ x[0], atol=1e-4)


def test_recall(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    pdf = df.orderBy("vec_id").toPandas()
    x, ids = np.stack(pdf.embedding.values), pdf.vec_id.values
    want = brute(x, 10)
    for got, asking in ((ann.neighbours(df, rerank=30), ids >= 0), (queries.QUERIES["op9_nearest_neighbours"](spark, data), ids % 100 == 0)):
        got = got.toPandas().groupby("vec_id").neighbour_id.apply(set)
        assert set(got.index) == set(ids[asking])
        assert np.mean([len(got[i] & set(ids[w])) / 10 for i, w in zip(ids[asking], want[asking])]) >= 0.9


def test_unsound_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    rows = [(f"v{k:03}", v.tolist()) for k, v in enumerate(x)] + [(f"w{k:03}", [1.0] * 8) for k in range(120)]
    df = spark.createDataFrame(rows + [("nan", [float("nan")] + [1.0] * 7), ("inf", [1.0] * 7 + [float("-inf")])], "vec_id string, embedding array<float>")
    got = ann.neighbours(df, k=10, rerank=20, probe_share=1.0).toPandas()
    assert set(got.vec_id) == {i for i, _ in rows} and not {"nan", "inf"} & set(got.neighbour_id)
    full = np.array([v for _, v in rows], np.float32)
    near = full @ full[400]
    better = int((near > near[400]).sum())
    mine = got[got.vec_id == "w000"].sort_values("rank").neighbour_id.tolist()
    assert mine[better:] == [f"w{k:03}" for k in range(1, 11 - better)]  # of 120 equal vectors those of the smallest ids


def test_neighbour_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, cell int, rank int")
    got = {(r.vec_id, r.neighbour_id): (r.score, r["rank"]) for r in ann.neighbours(df, k=2, probe_share=1.0).collect()}
    assert got[(1, 2)] == (1.0, 1) and got[(2, 1)] == (1.0, 1) and got[(1, 3)] == (0.0, 2)
    assert not any(None in k or k[0] == k[1] or {4, 5, 6} & set(k) for k in got)
    assert (7, 1) in got
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 1")).count() == 0
