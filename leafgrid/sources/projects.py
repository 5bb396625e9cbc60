"""Saved projects: blocks as JSON and an append-only table of edited texts; reports and packages as sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits
from ..functions import text as t

KEY = ["doc_id", "block_id"]


def save(blocks: DataFrame, folder: str) -> None:
    """Blocks are rewritten; texts already there are never overwritten: only those of new blocks are added."""
    spark = blocks.sparkSession
    blocks.write.mode("overwrite").json(f"{folder}/blocks")
    texts = blocks.select(*KEY, t.effective(F.col("corrected_text"), F.col("ocr_text")).alias("text"))
    there = spark.read.schema("doc_id long, block_id string, text string").json(f"{folder}/texts") if exists(spark, f"{folder}/texts") else None
    (texts if there is None else texts.join(there.select(*KEY), KEY, "left_anti")).write.mode("append").json(f"{folder}/texts")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something under the path, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def project_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): each document's blocks in order, as indented JSON; kinds are written by name."""
    kept = [c for c in blocks.columns if c != "doc_id"]
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "reading_order", *[c for c in kept if c not in ("page_no", "reading_order")])))
    return blocks.groupBy("doc_id").agg(ordered.alias("blocks")).select("doc_id", F.to_json(F.struct("doc_id", "blocks"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


BLOCKS = (
    "doc_id long, page_no int, block_id string, reading_order int, x double, y double, w double, h double, type string, ocr_text string, corrected_text string, conf double, source string, heading_level int, "
    "is_excluded boolean, is_edited boolean, requires_review boolean, image_path string, related_block_id string, writing_mode string, n_lines long"
)


def load(spark: SparkSession, folder: str, schema: str = BLOCKS) -> DataFrame:
    """Blocks with the texts over them."""
    blocks = spark.read.schema(schema).json(f"{folder}/blocks")
    return edits.overlay(blocks, spark.read.schema("doc_id long, block_id string, text string").json(f"{folder}/texts"))


def report(page_eval: DataFrame, doc_eval: DataFrame, folder: str) -> None:
    """metrics as JSON lines and an HTML table per document."""
    page_eval.write.mode("overwrite").json(f"{folder}/pages")
    doc_eval.write.mode("overwrite").json(f"{folder}/documents")
    html_report(page_eval, doc_eval).write.mode("overwrite").option("compression", "none").text(f"{folder}/html")


def html_report(page_eval: DataFrame, doc_eval: DataFrame) -> DataFrame:
    """(value): one HTML document per line and document."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit(" %"))
    row = F.concat(F.lit("<tr>"), cell(F.col("page_no")), cell(F.col("n_blocks")), cell(F.format_number("chars_included", 0)), cell(percent("coverage")), F.lit("</tr>"))
    rows = page_eval.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", row.alias("r")))), lambda s: s["r"]), "").alias("rows"))
    j = doc_eval.join(rows, "doc_id", "left")
    return j.select(F.concat(F.lit("<!DOCTYPE html><html><body><h1>"), F.col("doc_id").cast("string"), F.lit("</h1><p>"), percent("coverage"), F.lit("</p><table>"), F.coalesce("rows", F.lit("")), F.lit("</table></body></html>")).alias("value"))


def packed(files: DataFrame) -> DataFrame:
    """(doc_id, epub): zip archives of files (doc_id, pos, path, content binary), the mimetype first and stored."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for entries in f["files"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
                    for e in entries:
                        z.writestr(zipfile.ZipInfo(e["path"]), bytes(e["content"]), zipfile.ZIP_DEFLATED)
                out.append(buffer.getvalue())
            yield pd.DataFrame({"doc_id": f["doc_id"], "epub": out})

    grouped = files.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "content"))).alias("files"))
    return grouped.mapInPandas(build, "doc_id long, epub binary")


def write_packages(archives: DataFrame, folder: str) -> None:
    """One file per document, written by the executors into a folder that they share."""

    def write(rows) -> None:
        import os

        for r in rows:
            path = f"{folder}/{r['doc_id']}.epub"
            with open(f"{path}.part-{os.getpid()}", "wb") as f:
                f.write(bytes(r["epub"]))
            os.replace(f"{path}.part-{os.getpid()}", path)

    archives.foreachPartition(write)
