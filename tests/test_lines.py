import pytest

from leafgrid.operators import lines
from leafgrid.functions import text as t
from pyspark.sql import functions as F

LINE = "doc_id long, page_no int, line_no int, x double, y double, w double, h double, text string, conf double, source string, ink double"


def line(n, text, conf=0.9, source="Ocr", x=0.1, y=0.1, w=0.8, h=0.02, ink=None, doc=1, page=1):
    return (doc, page, n, x, y, w, h, text, conf, source, ink)


@pytest.mark.parametrize(
    "text,conf,source,kept",
    [("#@!", 0.45, "Ocr", False), ("#@!%&*", 0.95, "Ocr", True), ("#@!%&*", 0.75, "Ocr", False), ("some plain words", 0.75, "Ocr", True), ("1" * 32, 0.75, "Ocr", False), ("1234-5678-1234-5678", 0.75, "Ocr", True), ("1" * 20, 0.95, "Ocr", True), ("#@", 0.1, "PdfTextLayer", True)],
)
def test_junk(spark, text, conf, source, kept):
    df = spark.createDataFrame([line(0, text, conf, source)], LINE)
    assert lines.junk_filter(df).count() == kept


def test_junk_thresholds(spark):
    assert lines.junk_filter(spark.createDataFrame([line(0, "words", 0.85)], LINE), min_conf=0.9).count() == 0


@pytest.mark.parametrize("boxes,mode", [([(0.03, 0.4)] * 3 + [(0.2, 0.02)] * 2, "Vertical"), ([(0.5, 0.02)] * 2 + [(0.02, 0.1)], "Horizontal"), ([(0.02, 0.02)], "Horizontal")])
def test_writing_mode(spark, boxes, mode):
    df = spark.createDataFrame([line(k, "abcdef" if k < 3 else "ab", w=w, h=h) for k, (w, h) in enumerate(boxes)], LINE)
    assert lines.page_writing_mode(df).first()["writing_mode"] == mode


def test_document_mode(spark):
    df = spark.createDataFrame([(1, "Vertical"), (1, "Vertical"), (1, "Horizontal"), (2, "Vertical"), (2, "Horizontal")], "doc_id long, writing_mode string")
    assert {r.doc_id: r.writing_mode for r in lines.document_writing_mode(df).collect()} == {1: "Vertical", 2: "Horizontal"}


def test_language(spark):
    rows = [(1, "かなとかんじのぶん" * 10), (2, "plain english words " * 5), (3, "中文句子没有假名" * 10), (4, "한국어문장입니다" * 10), (5, "abc"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.language for r in lines.language(df).collect()} == {1: "ja", 2: "en", 3: "zh", 4: "ko", 5: "ja", 6: "ja"}


def test_layer_quality(spark):
    texts = {1: ("good text here", "good text here"), 2: ("raw text", None), 3: ("x" * 100, "x" * 20), 4: ("abcdefghij", "ab" + "" * 8), 5: ("wide", "wide"), 6: ("😀😀 ok", "😀😀 ok"), 7: ("", "")}
    raw = spark.createDataFrame([(k, 1, r) for k, (r, _) in texts.items()], "doc_id long, page_no int, raw_text string")
    df = spark.createDataFrame([line(0, p, doc=k, w=1.2 if k == 5 else 0.8) for k, (_, p) in texts.items() if p is not None], LINE)
    found = {r.doc_id: r.reason for r in lines.layer_quality(raw, df).collect()}
    assert found == {1: "usable", 2: "no positions", 3: "low coverage", 4: "private characters", 5: "bad bounds", 6: "usable", 7: "no text"}


def test_text_functions(spark):
    row = spark.createDataFrame([("ab", "cd", "日本", "　x ")], "a string, b string, c string, d string").select(
        t.joined(F.array("a", "b", "c")).alias("j"), t.is_blank(F.lit("　 ")).alias("blank"), t.natural_width(F.col("c")).alias("w"), t.number(F.lit(0.0625)).alias("n1"), t.number(F.lit(12.0)).alias("n2"), t.trimmed(F.col("d")).alias("t"),
        t.xml_safe(F.lit("a￾￿b")).alias("x"), t.title_text(F.lit(" "), F.lit("ocr")).alias("title"), t.effective(F.lit(""), F.lit("ocr")).alias("eff"), t.media_type(F.lit("a/b.JPG")).alias("m"),
    ).first()
    assert (row.j, row.blank, row.w, row.n1, row.n2, row.t, row.x, row.title, row.eff, row.m) == ("ab cd日本", True, 2.0, "0.063", "12", "x", "ab", "ocr", "", "image/jpeg")


@pytest.mark.parametrize(
    "a,b,ok",
    [("日木の朝です", "日本の朝です", True), ("これはよい文です", "あああああああ文", False), ("短い文", "短い文章", False), ("価格は12345円", "価格は12845円", False), ("これはい", "これほい", False), ("末, ab 木", "本, ab 木", True), ("同じ", "同じ", False), ("", "", False)],
)
def test_safe_correction(spark, a, b, ok):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(t.safe_correction(F.col("a"), F.col("b")).alias("ok")).first()["ok"] is ok


def test_safe_corrections_of_long_texts(spark):
    """the rule took a lambda for each character, three times over. The control character stands for itself."""
    plain = [("a\x01b 日木" + "字" * 50, "a\x01b 日本" + "字" * 50, True), ("ab c", "ab d", True), ("abc 日", "abd 日", False), ("a:b 日", "a;b 日", False), ("日 ab", "日 ac", True), ("𠮷木", "𠮷本", True), (None, "a", None), ("a", None, None)]
    df = spark.createDataFrame(plain, "a string, b string, ok boolean").withColumn("got", t.safe_correction(F.col("a"), F.col("b")))
    assert [(r.a, r.got) for r in df.collect()] == [(a, ok) for a, _, ok in plain]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
