"""Command line: info, convert, evaluate, analyze and export over tables of lines and regions.

Inputs are Parquet folders of lines and regions (and, for books with images, pages and images), as the decoders write them, or
--documents for plain texts. convert and export write an e-book per document, or with --format blocks the blocks as Parquet.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import pages
from .plans import convert
from .sources import projects, tables


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("leafgrid")
    p.add_argument("verb", choices=["info", "convert", "evaluate", "analyze", "export"])
    p.add_argument("inputs", nargs="+")
    p.add_argument("--output", "-o")
    p.add_argument("--layout", choices=["fixed", "reflow"], default="fixed")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--writing-mode", choices=["Auto", "Horizontal", "Vertical"], default="Auto")
    for mode in ("horizontal", "vertical"):
        p.add_argument(f"--{mode}", dest="writing_mode", action="store_const", const=mode.capitalize())
    p.add_argument("--format", choices=["epub", "blocks"], default="epub")
    p.add_argument("--image-quality", "--jpeg-quality", dest="jpeg_quality", type=int, default=85)
    p.add_argument("--max-image-size", type=int, default=2200, help="longest side of a page image that is kept as it is; 0 for any")
    p.add_argument("--dpi", type=int, default=300, help="that pages without an image size are taken to have been drawn at")
    p.add_argument("--enhance", action="store_true", help="show the processed images of pages")
    p.add_argument("--cover", action="store_true", help="the first page's image is the cover of a reflowing book")
    p.add_argument("--ollama", metavar="ANSWERS", nargs="?", const="answers", help="folder in the input with a model's answers (labels, corrections)")
    p.add_argument("--documents", action="store_true", help="inputs are tables of plain documents")
    p.add_argument("--master")
    a = p.parse_args(argv)
    for path in a.inputs:
        if "://" not in path and not os.path.exists(path):
            p.error(f"{path} does not exist")
    if a.verb != "info" and not a.output:
        p.error("--output is needed")
    return a


def read(spark, a: argparse.Namespace, path: str) -> tuple[DataFrame, DataFrame]:
    if a.documents:
        docs = spark.read.parquet(path)
        return tables.lines_of(docs), tables.regions_of(docs)
    return spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/regions")


def books(spark, a: argparse.Namespace, path: str, blocks: DataFrame, options: convert.Options, out: str) -> None:
    """An e-book for each document of the blocks; the folder's pages and images go into it, where there are some."""
    there = lambda name: None if a.documents or not projects.exists(spark, f"{path}/{name}") else spark.read.parquet(f"{path}/{name}")
    pages_, images_ = there("pages"), there("images")
    if pages_ is not None and not a.enhance:
        pages_ = pages_.withColumn("processed_image", F.lit(None).cast("string"))
    titles = blocks.groupBy("doc_id").agg(F.max("writing_mode").alias("writing_mode")) if "writing_mode" in blocks.columns else blocks.select("doc_id", F.lit("Horizontal").alias("writing_mode")).distinct()
    made = titles.join(convert.book_title(blocks), "doc_id", "left").select(
        "doc_id", F.coalesce("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"), F.lit("").alias("author"), F.lit("").alias("publisher"), F.lit(options.language or "en").alias("language"), "writing_mode", F.md5(F.concat(F.lit(path), F.col("doc_id").cast("string"))).alias("project_id")
    )
    if options.preserve_all_lines:
        if pages_ is None:  # pages of text alone, of the size of a letter
            pages_ = blocks.select("doc_id", "page_no", "writing_mode").distinct().select("doc_id", "page_no", F.lit(612).alias("width"), F.lit(792).alias("height"), F.lit("blank.png").alias("original_image"), F.lit(None).cast("string").alias("processed_image"), "writing_mode")
        else:
            points = lambda c: F.when(F.col("unit") == "px", (F.col(c) * 72 / options.dpi).cast("int")).otherwise(F.col(c)) if "unit" in pages_.columns else F.col(c)
            pages_ = pages_.join(blocks.select("doc_id", "page_no", "writing_mode").distinct(), ["doc_id", "page_no"]).withColumns({c: points(c) for c in ("width", "height")})
        files, held = convert.fixed_book(pages_, blocks, made), convert.page_images(pages_)
    else:
        covered = pages_ if options.cover else None
        files, held = convert.reflow_book(blocks, made, pages=covered), convert.book_images(blocks)
        if covered is not None:
            held = held.unionByName(convert.cover_images(covered))
    files = convert.with_images(files, held, images_) if images_ is not None else files.withColumn("content", F.encode("content", "utf-8"))
    os.makedirs(out, exist_ok=True)
    projects.write_packages(projects.packed(files), out)


def work(spark, a: argparse.Namespace, path: str, out: str) -> None:
    options = convert.Options(dpi=a.dpi, enhance=a.enhance, cover=a.cover, longest_side=a.max_image_size, preserve_all_lines=a.layout == "fixed", max_pages=a.max_pages, writing_mode=a.writing_mode, jpeg_quality=a.jpeg_quality)
    if a.verb == "export":
        blocks = projects.load(spark, path)
        if a.format == "blocks":
            return blocks.write.mode("overwrite").parquet(out)
        return books(spark, a, path, convert.complete(blocks), options, out)
    lines, regions = read(spark, a, path)
    lines = pages.first_pages(lines, options.max_pages)
    if a.verb == "evaluate":
        per_page, per_doc = convert.evaluate(lines, regions)
        return projects.report(per_page, per_doc, out)
    blocks = convert.complete(convert.fixed_blocks(lines, options) if options.preserve_all_lines else convert.reflow_blocks(lines, regions))
    if a.verb == "analyze":
        return projects.save(blocks, out)
    if a.ollama and not a.documents:
        answers = [spark.read.parquet(f) if projects.exists(spark, f) else None for f in (f"{path}/{a.ollama}/labels", f"{path}/{a.ollama}/corrections")]
        blocks = convert.with_models(blocks, *answers)
    if a.format == "blocks":
        return blocks.write.mode("overwrite").parquet(out)
    books(spark, a, path, blocks, options, out)


def main(argv: list[str] | None = None) -> int:
    """0 if all inputs went well; one that fails doesn't stop the others."""
    from .session import session

    a = parse(sys.argv[1:] if argv is None else argv)
    spark = session(a.master)
    failed = 0
    for path in a.inputs:
        try:
            if a.verb == "info":
                lines, _ = read(spark, a, path)
                pages.page_metadata(lines.groupBy("doc_id", "page_no").agg(F.array_join(F.collect_list("text"), "").alias("raw_text"))).orderBy("doc_id").show()
            else:
                stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
                work(spark, a, path, a.output if len(a.inputs) == 1 else f"{a.output.rstrip('/')}/{stem}")
        except Exception as e:
            failed += 1
            print(f"{path}: {e}", file=sys.stderr)
    print(f"{len(a.inputs) - failed} ok, {failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
