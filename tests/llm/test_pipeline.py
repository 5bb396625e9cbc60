import numpy as np

import corpus_pipeline
from leafgrid.llm import queries

GOOD = "the house of the old man stood near the river and it was quiet in the evening when they came to see him for a talk about harvest and roads"


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names) and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = GOOD.split() + [f"word{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choice(words, 90)), f"s{k % 3}") for k in range(60)]
    item = " ".join(rng.choice(words, 30))
    secret = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    extra = [(100, rows[4][1], "s0"), (101, rows[5][1] + " end", "s1"), (102, rows[6][1] + " " + item, "s2"), (103, "BUY NOW!! " * 60, "s0"), (104, rows[7][1] + " you worthless idiot", "s1"), (105, " ".join(rng.choice(words, 80)) + f' token = "{secret}"', "s2"), (106, None, "s0"), (107, "", None)]
    rows[6] = (6, " ".join(rng.choice(words, 90)), "s0")
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        left[name] = docs
        if k < 4:
            assert docs.columns == frame.columns
    ids = [{r.doc_id for r in df.collect()} for df in left.values()]
    clean = set(range(60)) | {105}
    assert ids[0] == clean | {100, 101, 102}
    assert ids[1] == clean | {102}
    assert ids[2] == ids[3] == ids[4] == clean
    text = {r.doc_id: r.text for r in left["secret scans"].collect()}
    assert secret not in text[105] and text[3] == rows[3][1]
    assert sorted(corpus_pipeline.run(spark, d).collect()) == sorted(left["mixing sources to target weights"].collect())


def stages(spark, frame, d):
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        out.append(docs)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, slot int, keep boolean"


def test_empty_table(spark, tmp_path):
    out = stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert [df.count() for df in out] == [0] * 5 and out[3].columns == out[0].columns and out[0].columns[-3:] == ["fp", "slot", "keep"]


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = GOOD.split() + [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 90)) for _ in range(40)]
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0"), (None, texts[5] + f' token = "{key}"', "en", "s1"), (None, texts[5], "en", ""), (200, " ".join(rng.choice(words, 60_000)), "en", "s1"), (201, None, None, None), (202, "", "en", "s1")]
    out = stages(spark, spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, True) for r in rows], SCHEMA), str(tmp_path))
    ids = [sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect()) for df in out[:4]]
    assert ids[0] == ids[1] == ids[2] == ids[3] == sorted([*range(40), 3, -1, -1, 200])
    assert not any(key in r.text for r in out[3].collect())
    last = out[4].collect()
    assert {r.doc_id for r in last} == {*range(40), None, 200} and {r.source for r in last} == {None, "", "s0", "s1", "s2"}
