"""Paragraphs from lines, and drop caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

PAGE = ["doc_id", "page_no"]


def paragraph_ids(blocks: DataFrame) -> DataFrame:
    """blocks with para: a running number that rises where a line doesn't continue the one before it."""
    w = Window.partitionBy(*PAGE).orderBy("reading_order")
    p = {c: F.lag(c).over(w) for c in ("x", "y", "w", "h", "type", "source", "is_excluded", "is_edited")}
    low = F.least("h", p["h"])
    gap = F.col("y") - (p["y"] + p["h"])
    beside = F.least(F.col("x") + F.col("w"), p["x"] + p["w"]) - F.greatest("x", p["x"])
    joins = (
        F.col("type").isin("Body", "Aside") & (F.col("type") == p["type"]) & F.col("source").eqNullSafe(p["source"]) & ~F.col("is_excluded") & ~p["is_excluded"] & ~F.col("is_edited") & ~p["is_edited"]
        & (low > 0) & (F.try_divide(beside, F.least("w", p["w"])) >= 0.5) & (F.greatest("h", p["h"]) / low <= 1.4) & (gap >= -0.5 * low) & (gap <= 0.8 * low) & (F.col("x") - p["x"] <= 0.9 * F.col("h"))
    )
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return blocks.withColumn("starts", starts).withColumn("para", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def merge(blocks: DataFrame) -> DataFrame:
    """One row per paragraph: initials set before their lines, texts joined, boxes united, the lowest confidence; block ids stay those of first lines, orders are renumbered."""
    blocks = with_drop_caps(blocks)
    rows = F.array_sort(F.collect_list(F.struct("reading_order", "ocr_text")))
    first = lambda c: F.min_by(c, "reading_order").alias(c)
    more = [first(c) for c in ("related_block_id", "corrected_text", "image_path") if c in blocks.columns]
    out = paragraph_ids(blocks).groupBy(*PAGE, "para").agg(
        first("block_id"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), first("type"), first("source"), first("heading_level"), first("is_excluded"), first("is_edited"),
        t.joined(F.transform(rows, lambda s: s["ocr_text"])).alias("ocr_text"), F.min("conf").alias("conf"), F.bool_or("requires_review").alias("requires_review"), F.count("*").alias("n_lines"), *more,
    )
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("para")) - 1
    return out.withColumn("reading_order", order).withColumn("w", F.col("right") - F.col("x")).withColumn("h", F.col("bottom") - F.col("y")).drop("para", "right", "bottom")


def _chosen(blocks: DataFrame) -> DataFrame:
    """blocks with _done: the initials of their page and the lines that got them. Windows over the page find them, so the rows are neither shuffled again nor joined."""
    text, page = F.coalesce("ocr_text", F.lit("")), Window.partitionBy(*PAGE)
    b = blocks.withColumn("_long", text.rlike(rf"{t.VISIBLE}[\s\S]+?{t.VISIBLE}")).withColumn("_h", F.when(F.col("_long") & (F.col("h") > 0), F.col("h")))
    b = b.withColumn("_usual", F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _h DESC) OVER (PARTITION BY doc_id, page_no)")).drop("_h")
    is_cap = ~F.col("_long") & ~t.is_blank(text) & ~F.col("is_excluded") & (F.col("h") >= 1.5 * F.col("_usual"))
    cap = F.struct(F.col("reading_order").alias("o"), F.col("block_id").alias("id"), t.trimmed(F.col("ocr_text")).alias("text"), F.col("conf").cast("double").alias("conf"), F.col("requires_review").alias("review"), "x", "y", "h")
    b = b.withColumn("_caps", F.array_sort(F.collect_list(F.when(is_cap, cap)).over(page))).drop("_usual")
    beside = lambda c, x, y, h: (F.least(y + h, c["y"] + c["h"]) - F.greatest(y, c["y"]) > 0) & (x >= c["x"])
    wanted = F.col("_long") & ~F.col("is_excluded") & F.exists("_caps", lambda c: beside(c, F.col("x"), F.col("y"), F.col("h")))
    line = F.struct("y", "reading_order", F.col("block_id").alias("id"), "is_edited", "x", "h")
    b = b.withColumn("_lines", F.array_sort(F.collect_list(F.when(wanted, line)).over(page))).drop("_long")
    empty = F.expr("cast(array() as array<struct<cap_id: string, target_id: string, cap: string, conf: double, review: boolean>>)")

    def choose(done, c):
        left = F.filter("_lines", lambda l: beside(c, l["x"], l["y"], l["h"]) & ~F.exists(done, lambda d: d["target_id"] == l["id"]))  # noqa: E741
        got = F.struct(c["id"].alias("cap_id"), left[0]["id"].alias("target_id"), c["text"].alias("cap"), c["conf"].alias("conf"), c["review"].alias("review"))
        return F.when((F.size(left) > 0) & ~left[0]["is_edited"], F.concat(done, F.array(got))).otherwise(done)

    return b.withColumn("_done", F.aggregate("_caps", empty, choose)).drop("_caps", "_lines")


def drop_caps(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, cap_id, target_id, text): large initials and the topmost line beside each that starts no further left.

    Initials choose in order of reading; where two want one line, the first has it and the other takes its next best. One whose
    line was edited by hand stays alone. The choice is made among the initials' ranked lines only.
    """
    mine = F.filter("_done", lambda d: d["target_id"] == F.col("block_id"))
    return _chosen(blocks).select(*PAGE, "ocr_text", F.explode(mine).alias("d")).select(*PAGE, "d.cap_id", "d.target_id", F.concat("d.cap", "ocr_text").alias("text"))


def with_drop_caps(blocks: DataFrame) -> DataFrame:
    """blocks whose initials stand before the texts of their lines; an initial's box isn't taken over, or the heights of lines couldn't be compared any more."""
    mine = F.filter("_done", lambda d: d["target_id"] == F.col("block_id"))
    gone = F.exists("_done", lambda d: d["cap_id"] == F.col("block_id"))
    kept = _chosen(blocks).filter(~gone).withColumn("_cap", F.try_element_at(mine, F.lit(1)))
    has = F.col("_cap").isNotNull()
    text = F.concat("_cap.cap", "ocr_text")
    return kept.select(
        *[F.when(has, v).otherwise(F.col(c)).alias(c) if (v := {"ocr_text": text, "conf": F.least("conf", "_cap.conf"), "requires_review": F.col("requires_review") | F.col("_cap.review")}.get(c)) is not None else F.col(c) for c in blocks.columns]
    )
