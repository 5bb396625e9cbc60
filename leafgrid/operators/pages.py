"""Page and document rows: which pages need recognition, fallbacks, status, counts, file lists, paper profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

PAGE = ["doc_id", "page_no"]


def page_metadata(raw: DataFrame) -> DataFrame:
    """Per document: pages, and those with any text. raw: (doc_id, page_no, raw_text)."""
    return raw.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(~t.is_blank(F.col("raw_text"))).alias("text_pages"))


def first_pages(pages: DataFrame, limit: int | None) -> DataFrame:
    """A filter on the page number, so that it reaches the scan; no or a non-positive limit keeps all."""
    return pages if not limit or limit <= 0 else pages.filter(F.col("page_no") <= limit)


def need_ocr(quality: DataFrame, force: bool = False) -> DataFrame:
    return quality.filter(F.lit(force) | ~F.col("usable")).select(*PAGE)


def fallback_blocks(quality: DataFrame, raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """A block of the whole page for pages without blocks whose rejected layer has text."""
    rejected = quality.filter(~F.col("usable")).select(*PAGE).join(raw, PAGE).filter(~t.is_blank(F.col("raw_text")))
    bare = rejected.join(blocks.select(*PAGE).distinct(), PAGE, "left_anti")
    zero, one = F.lit(0.0), F.lit(1.0)
    return bare.select(
        *PAGE, F.format_string("p%04d-b%04d", "page_no", F.lit(1)).alias("block_id"), zero.alias("x"), zero.alias("y"), one.alias("w"), one.alias("h"), F.lit("Body").alias("type"), t.trimmed(F.col("raw_text")).alias("ocr_text"),
        F.lit(0.5).alias("conf"), F.lit("PdfTextLayer").alias("source"), F.lit(0).alias("reading_order"), F.lit(True).alias("requires_review"),
    )


def page_status(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages with status: OcrCompleted where there is a block, else Error."""
    done = blocks.select(*PAGE).distinct().withColumn("done", F.lit(True))
    return pages.join(done, PAGE, "left").withColumn("status", F.when(F.col("done"), "OcrCompleted").otherwise("Error")).drop("done")


def source_counts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: pages with any block of a text layer, with any recognised one, with none but unknown ones (true for none at all), blocks to review and blocks edited by hand."""
    per = blocks.groupBy(*PAGE).agg(F.bool_or(F.col("source") == "PdfTextLayer").alias("pdf"), F.bool_or(F.col("source") == "Ocr").alias("ocr"), F.bool_and(F.col("source") == "Unknown").alias("unknown"), F.count_if("requires_review").alias("review"), F.count_if("is_edited").alias("edited"))
    j = pages.select(*PAGE).join(per, PAGE, "left")
    return j.groupBy("doc_id").agg(F.count_if(F.coalesce("pdf", F.lit(False))).alias("pdf_pages"), F.count_if(F.coalesce("ocr", F.lit(False))).alias("ocr_pages"), F.count_if(F.coalesce("unknown", F.lit(True))).alias("unknown_pages"), F.coalesce(F.sum("review"), F.lit(0)).alias("review_blocks"), F.coalesce(F.sum("edited"), F.lit(0)).alias("edited_blocks"))


def without_cover(pages: DataFrame, cover: bool = True) -> DataFrame:
    """Without each document's first page where a cover is wanted; a document of one page keeps it."""
    if not cover:
        return pages
    whole = Window.partitionBy("doc_id")
    return pages.withColumn("_n", F.count("*").over(whole)).withColumn("_first", F.min("page_no").over(whole)).filter((F.col("_n") == 1) | (F.col("page_no") > F.col("_first"))).drop("_n", "_first")


def projects(inputs: DataFrame) -> DataFrame:
    """(path, title, project_id, epub_name): the title is the file's stem, the id derived from the path."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return inputs.select("path", stem.alias("title"), F.md5("path").alias("project_id"), F.concat(F.regexp_replace("path", r"\.[^.\\/]*$", ""), F.lit(".epub")).alias("epub_name"))


def distinct_inputs(inputs: DataFrame) -> DataFrame:
    """The first of paths that differ in case only, ordered by name without case. inputs: (pos, path)."""
    once = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("pos"))
    return inputs.filter(F.lower("path").endswith(".pdf")).withColumn("r", once).filter("r = 1").select("pos", "path").orderBy(F.lower("path"))


def batch_status(results: DataFrame) -> DataFrame:
    return results.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))


def log_tail(log: DataFrame, keep: int = 5000) -> DataFrame:
    """The last rows of a log (the limit is the feature)."""
    return log.orderBy(F.desc("seq")).limit(keep)


def paper_profile(stats: DataFrame, luminance: float = 176, share: float = 0.25, spread: float = 1.5, least: int = 3) -> DataFrame:
    """Per document, upper medians of luminance and colour over its paper pages, without outliers in luminance; none below three paper pages.

    stats: (doc_id, page_no, luminance, share, b, g, r).
    """
    paper = stats.filter((F.col("luminance") >= luminance) & (F.col("share") >= share))
    med = paper.groupBy("doc_id").agg(F.count("*").alias("n"), g.upper_median("luminance").alias("med")).filter(F.col("n") >= least)
    dev = paper.join(med, "doc_id").withColumn("dev", F.abs(F.col("luminance") - F.col("med")))
    mad = dev.groupBy("doc_id").agg(g.upper_median("dev").alias("mad"))
    marked = dev.join(mad, "doc_id").withColumn("inlier", (F.col("mad") <= 0) | (F.col("dev") <= spread * F.col("mad")))
    marked = marked.withColumn("inliers", F.count_if("inlier").over(Window.partitionBy("doc_id"))).filter(F.col("inlier") | (F.col("inliers") < least))
    return marked.groupBy("doc_id").agg(*[g.upper_median(c).alias(c) for c in ("luminance", "b", "g", "r")])


def editor_labels(blocks: DataFrame, limit: int = 14) -> DataFrame:
    """(doc_id, page_no, block_id, label): the order and the first characters, for a list to choose from; hidden blocks too."""
    text = F.regexp_replace(F.coalesce(t.effective(F.col("corrected_text"), F.col("ocr_text")), F.lit("")), "\n", " ")
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return blocks.select(*PAGE, "block_id", F.concat(F.col("reading_order").cast("string"), F.lit(": "), cut).alias("label"))


def distinct_images(blocks: DataFrame) -> DataFrame:
    """(doc_id, image_path, image_no): each image once per document, numbered as first seen."""
    first = blocks.filter("image_path is not null").groupBy("doc_id", "image_path").agg(F.min(F.struct("page_no", "reading_order")).alias("at"))
    return first.select("doc_id", "image_path", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "image_path")).alias("image_no"))


def output_names(inputs: DataFrame, output: str | None = None, single: bool = False) -> DataFrame:
    """inputs (path) with out: beside the input, or in the folder output, or the file output itself if there is one input."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    beside = F.concat(F.regexp_replace("path", r"\.[^.\\/]*$", ""), F.lit(".epub"))
    return inputs.withColumn("out", beside if output is None else F.lit(output) if single else F.concat(F.lit(output.rstrip("/") + "/"), stem, F.lit(".epub")))


def display_images(pages: DataFrame) -> DataFrame:
    """pages with display_image: the processed one if there is one, else the original."""
    return pages.withColumn("display_image", F.coalesce("processed_image", "original_image"))


def observed(blocks: DataFrame, name: str = "pages") -> tuple[DataFrame, object]:
    """blocks and an Observation that holds the run's counts once an action has run: blocks, those to review, low confidence."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return blocks.observe(watch, F.count(F.lit(1)).alias("blocks"), F.count_if("requires_review").alias("review"), F.count_if(F.col("conf") < 0.85).alias("low_confidence")), watch
