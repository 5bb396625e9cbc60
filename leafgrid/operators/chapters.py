"""Chapters of a document from its blocks in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def chapters(blocks: DataFrame, fallback_title: str = "Front matter", min_blocks: int = 3) -> DataFrame:
    """(doc_id, chapter_no, chapter_id, title, heading_level, block_ids).

    A title opens a chapter if none is open yet, if only the front matter is, or if the open one holds min_blocks blocks; else it stays
    in the text. So the next accepted title is the first one at least min_blocks + 1 rows on; that chain is walked on the
    titles alone, in one fold per document over its (few) titles. A document's block ids travel once, as one array; of the texts, only titles do.
    """
    kept = blocks.filter(~F.col("is_excluded"))
    title = F.when(F.col("type") == "ChapterTitle", F.struct(t.title_text(F.col("corrected_text"), F.col("ocr_text")).alias("title")))
    rows = kept.select("doc_id", F.struct("page_no", "reading_order", "block_id", title.alias("opening")).alias("row"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    opening = F.transform("rows", lambda r, k: F.when(r["opening"].isNotNull(), F.struct((k + 1).alias("rn"), r["opening"]["title"].alias("title"))))
    docs = docs.select("doc_id", F.transform("rows", lambda r: r["block_id"]).alias("ids"), F.filter(opening, lambda r: r.isNotNull()).alias("at"))
    none = F.expr("cast(array() as array<struct<rn: int, title: string>>)")
    walk = F.aggregate("at", none, lambda got, x: F.when((F.size(got) == 0) | (x["rn"] >= F.element_at(got, -1)["rn"] + min_blocks + 1), F.concat(got, F.array(x))).otherwise(got))
    opened = docs.select("doc_id", "ids", walk.alias("at"))
    front = F.array(F.struct(F.lit(0).alias("rn"), F.lit(None).cast("string").alias("title")))
    parts = F.when((F.size("at") > 0) & (F.get("at", F.lit(0))["rn"] == 1), F.col("at")).otherwise(F.concat(front, F.col("at")))
    cut = opened.select("doc_id", "ids", parts.alias("parts"))
    until = lambda k: F.coalesce(F.get("parts", k + 1)["rn"], F.size("ids") + 1)
    made = F.transform("parts", lambda p, k: F.struct((k + 1).alias("chapter_no"), p["title"].alias("title"), F.slice("ids", p["rn"] + 1, until(k) - p["rn"] - 1).alias("block_ids")))
    out = cut.select("doc_id", F.explode(made).alias("c")).select("doc_id", "c.*")
    return out.select("doc_id", "chapter_no", F.format_string("chapter-%03d", "chapter_no").alias("chapter_id"), F.coalesce("title", F.lit(fallback_title)).alias("title"), F.lit(1).alias("heading_level"), "block_ids")
