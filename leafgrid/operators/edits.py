"""Model answers, manual edits and their overlay on blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

KEY = ["doc_id", "block_id"]
HIDDEN = ("Header", "Footer", "PageNumber")


def label_candidates(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.col("is_excluded") & ~F.col("type").isin("Figure", "Table"))


def correction_candidates(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("source") == "Ocr") & ~F.col("is_excluded") & F.col("corrected_text").isNull() & ~F.col("type").isin("Figure", "Table", "Decorative") & ~t.is_blank(F.col("ocr_text")))


def chunked(blocks: DataFrame, size: int = 20) -> DataFrame:
    """blocks with chunk_no: requests of so many blocks of a page."""
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("reading_order", "block_id")) - 1
    return blocks.withColumn("chunk_no", F.floor(order / size).cast("int"))


def prompt_rows(blocks: DataFrame, limit: int = 80) -> DataFrame:
    """(doc_id, page_no, block_id, label, excerpt): one line of text each, cut with an ellipsis."""
    flat = F.regexp_replace(F.coalesce("ocr_text", F.lit("")), "\n", " ")
    excerpt = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)
    return blocks.select("doc_id", "page_no", "block_id", t.label_key(F.col("type")).alias("label"), excerpt.alias("excerpt"))


def items(responses: DataFrame) -> DataFrame:
    """The entries of {"blocks": [...]} answers (doc_id, page_no, chunk_no, json), one row each, decoded one by one so that a bad one spoils no other."""
    decoded = responses.select("doc_id", "page_no", "chunk_no", F.try_parse_json("json").alias("v"))
    listed = decoded.select("doc_id", "page_no", "chunk_no", F.expr("try_variant_get(v, '$.blocks', 'array<variant>')").alias("list"))
    return listed.select("doc_id", "page_no", "chunk_no", F.posexplode("list").alias("pos", "item"))


def _first(rows: DataFrame) -> DataFrame:
    """The first entry per block, before anything else about it is checked."""
    once = F.row_number().over(Window.partitionBy(*KEY).orderBy("page_no", "chunk_no", "pos"))
    return rows.withColumn("once", once).filter("once = 1").drop("once")


def _kind(path: str) -> str:
    return f"schema_of_variant(variant_get(item, '{path}', 'variant'))"


def labels(responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, new_type, new_level, confidence): valid entries for candidate blocks."""
    rows = items(responses).select("doc_id", "page_no", "chunk_no", "pos", "item", F.expr("try_variant_get(item, '$.id', 'string')").alias("block_id")).filter("block_id is not null")
    rows = rows.join(label_candidates(blocks).select(*KEY), KEY, "left_semi")
    rows = _first(rows).select(
        *KEY, F.expr("try_variant_get(item, '$.type', 'string')").alias("key"), F.expr("try_variant_get(item, '$.headingLevel', 'double')").alias("level"), F.expr("try_variant_get(item, '$.confidence', 'double')").alias("confidence")
    )
    kind = t.type_of_label(F.lower("key"))
    ok = kind.isNotNull() & F.coalesce((F.col("level") >= 0) & (F.col("level") <= 6) & (F.col("level") == F.floor("level")), F.lit(True)) & (F.col("confidence") >= 0) & (F.col("confidence") <= 1)
    return rows.filter(ok).select(*KEY, kind.alias("new_type"), F.when(F.col("level") > 0, F.col("level").cast("int")).alias("new_level"), "confidence")


def apply_labels(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """A type that would hide a shown block only asks for review; a hidden block follows the label."""
    j = blocks.join(new, KEY, "left")
    hides = F.col("new_type").isin(*HIDDEN)
    given = F.col("new_type").isNotNull()
    return j.select(
        *[c for c in blocks.columns if c not in ("type", "heading_level", "is_excluded", "requires_review")], F.coalesce("new_type", "type").alias("type"), F.when(given, F.col("new_level")).otherwise(F.col("heading_level")).alias("heading_level"),
        F.when(given & F.col("is_excluded"), hides).otherwise(F.col("is_excluded")).alias("is_excluded"), F.when(given & ~F.col("is_excluded") & hides, True).otherwise(F.col("requires_review")).alias("requires_review"),
    )


def corrections(responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, new_text): safe corrections of candidate blocks."""
    rows = items(responses).select("doc_id", "page_no", "chunk_no", "pos", F.expr("try_variant_get(item, '$.id', 'string')").alias("block_id"), F.expr("try_variant_get(item, '$.text', 'string')").alias("new_text")).filter("block_id is not null")
    known = correction_candidates(blocks).select(*KEY, "ocr_text")
    return _first(rows.join(known, KEY)).filter(F.col("new_text").isNotNull() & t.safe_correction(F.col("ocr_text"), F.col("new_text"))).select(*KEY, "new_text")


def apply_corrections(blocks: DataFrame, new: DataFrame) -> DataFrame:
    return blocks.join(new, KEY, "left").withColumn("corrected_text", F.coalesce("new_text", "corrected_text")).drop("new_text")


def overlay(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited text files over blocks: one that differs from the recognised text becomes a manual correction."""
    e = edits.select(*KEY, t.normalised(F.col("text")).alias("edit"))
    differs = F.col("edit").isNotNull() & (F.col("edit") != t.normalised(F.coalesce("ocr_text", F.lit(""))))
    return blocks.join(e, KEY, "left").withColumn("corrected_text", F.when(differs, F.col("edit")).otherwise(F.col("corrected_text"))).withColumn("is_edited", differs | F.col("is_edited")).drop("edit")


def manual(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Editor actions (doc_id, block_id, set_type?, set_level?, set_excluded?, set_text?, revert), one row per block at most.

    Level 0 clears; a text equal to the recognised one clears the correction and the edited mark; any text clears the review mark;
    reverting clears the correction and leaves the edited mark.
    """
    j = blocks.join(edits, KEY, "left")
    same = F.col("set_text") == F.col("ocr_text")
    text = F.col("set_text").isNotNull()
    return j.select(
        *[c for c in blocks.columns if c not in ("type", "heading_level", "is_excluded", "corrected_text", "is_edited", "requires_review")], F.coalesce("set_type", "type").alias("type"),
        F.when(F.col("set_level") == 0, None).otherwise(F.coalesce("set_level", "heading_level")).alias("heading_level"), F.coalesce("set_excluded", "is_excluded").alias("is_excluded"),
        F.when(F.coalesce("revert", F.lit(False)) | F.coalesce(same, F.lit(False)), None).otherwise(F.coalesce("set_text", "corrected_text")).alias("corrected_text"),
        F.when(text, ~same).otherwise(F.col("is_edited")).alias("is_edited"), F.when(text, False).otherwise(F.col("requires_review")).alias("requires_review"),
    )
