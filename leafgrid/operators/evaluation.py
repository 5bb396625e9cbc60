"""Evaluation of laid-out pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

COUNTS = ["n_blocks", "chars_total", "chars_included", "chars_excluded", "chars_dropped", "figures", "figures_with_image", "headings", "low_confidence"]


def page_evaluation(blocks: DataFrame) -> DataFrame:
    n = t.nonspace(F.coalesce(t.effective(F.col("corrected_text"), F.col("ocr_text")), F.lit("")))
    out, figure = F.col("is_excluded"), F.col("type") == "Figure"
    sums = blocks.groupBy("doc_id", "page_no").agg(
        F.count("*").alias("n_blocks"), F.sum(n).alias("chars_total"), F.sum(F.when(~out, n).otherwise(0)).alias("chars_included"), F.sum(F.when(out, n).otherwise(0)).alias("chars_excluded"),
        F.count_if(figure).alias("figures"), F.count_if(figure & F.col("image_path").isNotNull()).alias("figures_with_image"), F.count_if(F.col("type").isin("ChapterTitle", "SectionHeading", "Subheading")).alias("headings"),
        F.count_if(~out & (F.col("conf") < 0.85)).alias("low_confidence"),
    )
    sums = sums.withColumn("chars_dropped", F.col("chars_total") - F.col("chars_included") - F.col("chars_excluded"))
    return sums.select("doc_id", "page_no", *COUNTS, coverage().alias("coverage"))


def coverage():
    rest = F.col("chars_total") - F.col("chars_excluded")
    return F.when(rest <= 0, 1.0).otherwise(F.col("chars_included") / rest)


def document_evaluation(pages: DataFrame, per_page: DataFrame) -> DataFrame:
    """pages: (doc_id, page_no), so that pages without blocks count as pages."""
    all_pages = pages.select("doc_id", "page_no").join(per_page, ["doc_id", "page_no"], "left").fillna(0, COUNTS)
    sums = all_pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n_blocks") > 0).alias("pages_with_blocks"), *[F.sum(c).alias(c) for c in COUNTS])
    rate = F.when(F.col("figures") == 0, 1.0).otherwise(F.col("figures_with_image") / F.col("figures"))
    return sums.withColumn("coverage", coverage()).withColumn("figure_rate", rate)


def page_confidence(found: DataFrame) -> DataFrame:
    """(doc_id, page_no, confidence): the mean over the lines that have character scores of their means, 0 for none. found: (doc_id, page_no, scores)."""
    mean = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / F.size("scores"))
    return found.select("doc_id", "page_no", mean.alias("m")).groupBy("doc_id", "page_no").agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("confidence"))


def type_histogram(blocks: DataFrame) -> DataFrame:
    """Per page the number of blocks of each type, by the types' own order."""
    n = blocks.groupBy("doc_id", "page_no", "type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(t.type_ordinal(F.col("type")).alias("o"), F.col("type").alias("t"), F.col("n").alias("n"))))
    return n.groupBy("doc_id", "page_no").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["t"], e["n"]))).alias("types"))
