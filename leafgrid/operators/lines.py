"""Operators on text lines (doc_id, page_no, line_no, x, y, w, h, text, conf, source, ink)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t


def nonblank(lines: DataFrame) -> DataFrame:
    return lines.filter(~t.is_blank(F.col("text")))


def junk_rule(min_conf: float = 0.6, sure_conf: float = 0.85, min_words: float = 0.5, digit_run: int = 16) -> Column:
    """Whether a line stays: text layers always, sure ones too; else it must look like words and hold no long run of digits."""
    text = F.col("text")
    return (F.col("source") != "Ocr") | (F.col("conf") >= min_conf) & ((F.col("conf") >= sure_conf) | (t.word_ratio(text) >= min_words) & ~t.has_digit_run(text, digit_run))


def junk_filter(lines: DataFrame, **thresholds: float) -> DataFrame:
    return lines.filter(junk_rule(**thresholds))


def junk_counts(lines: DataFrame, **thresholds: float) -> DataFrame:
    """Per page, the lines kept and dropped."""
    keep = junk_rule(**thresholds)
    return lines.groupBy("doc_id", "page_no").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def page_writing_mode(lines: DataFrame) -> DataFrame:
    """Vertical where tall lines hold more characters than wide ones; lines of one character don't count."""
    n = t.nonspace(F.col("text"))
    weight = lambda cond: F.sum(F.when((n >= 2) & cond, n).otherwise(0))
    tall, wide = weight(F.col("h") > 1.5 * F.col("w")), weight(F.col("w") > 1.5 * F.col("h"))
    return lines.groupBy("doc_id", "page_no").agg(F.when(tall > wide, "Vertical").otherwise("Horizontal").alias("writing_mode"))


def document_writing_mode(modes: DataFrame) -> DataFrame:
    """By strict majority of the pages."""
    return modes.groupBy("doc_id").agg(F.when(F.count_if(F.col("writing_mode") == "Vertical") * 2 > F.count("*"), "Vertical").otherwise("Horizontal").alias("writing_mode"))


def language(texts: DataFrame, fallback: str = "ja") -> DataFrame:
    """(doc_id, language) from shares of scripts; the fallback below 50 characters of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sums = texts.groupBy("doc_id").agg(*[F.sum(t.count_of(text, p)).alias(k) for k, p in (("kana", t.KANA), ("hangul", t.HANGUL), ("ideo", t.IDEOGRAPH), ("latin", "[A-Za-z]"))])
    total = F.col("kana") + F.col("hangul") + F.col("ideo") + F.col("latin")
    found = F.when(total < 50, fallback).when(F.col("kana") * 100 >= total * 5, "ja").when(F.col("hangul") * 100 >= total * 30, "ko").when(F.col("ideo") * 100 >= total * 30, "zh").otherwise("en")
    return sums.select("doc_id", "kana", "hangul", "ideo", "latin", found.alias("language"))


def layer_quality(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """Verdict on the text layer of each page. raw: (doc_id, page_no, raw_text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = lines.groupBy("doc_id", "page_no").agg(
        F.sum(t.nonspace(text)).alias("positioned"), F.sum(t.count_of(text, t.INVALID)).alias("invalid"), F.sum(t.count_of(text, t.PRIVATE)).alias("private"), F.count("*").alias("n_lines"), F.count_if(~g.usable(g.box())).alias("bad")
    )
    out = raw.select("doc_id", "page_no", t.nonspace(F.coalesce("raw_text", F.lit(""))).alias("raw_chars")).join(placed, ["doc_id", "page_no"], "left").fillna(0)
    coverage = F.when(F.col("raw_chars") > 0, F.least(F.lit(1.0), F.col("positioned") / F.col("raw_chars"))).otherwise(0.0)
    reason = (
        F.when(F.col("raw_chars") == 0, "no text").when(F.col("positioned") == 0, "no positions").when(coverage < 0.5, "low coverage").when(F.col("invalid") > 0.02 * F.col("positioned"), "invalid characters")
        .when(F.col("private") > 0.2 * F.col("positioned"), "private characters").when(F.col("bad") > 0.1 * F.col("n_lines"), "bad bounds").otherwise("usable")
    )
    return out.select("doc_id", "page_no", "raw_chars", "positioned", F.round(coverage, 6).alias("coverage"), reason.alias("reason"), (reason == "usable").alias("usable"))
