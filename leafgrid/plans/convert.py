"""Whole plans: lines and regions to blocks, fixed or reflowing, and on to e-book files and evaluation.

Every stage works on all documents at once and keys on (doc_id, page_no) or doc_id, so pages and documents are the units of
parallelism.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chapters as ch
from ..operators import columns, edits, evaluation, layout, lines as ln, markup, pages as pg, paragraphs

PAGE = ["doc_id", "page_no"]


@dataclass(frozen=True)
class Options:
    dpi: int = 300
    preserve_all_lines: bool = True
    enhance: bool = False
    force_ocr: bool = False
    language: str | None = None
    max_pages: int | None = None
    writing_mode: str = "Auto"
    jpeg_quality: int = 85
    longest_side: int = 2200
    cover: bool = False

    def __post_init__(self) -> None:
        if self.writing_mode not in ("Auto", "Horizontal", "Vertical"):
            raise ValueError(f"unknown writing mode {self.writing_mode}")
        object.__setattr__(self, "jpeg_quality", min(100, max(1, self.jpeg_quality)))


def fixed_blocks(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Every line a block, in the order of columns; vertical pages are read by transposed boxes."""
    shown = pg.first_pages(ln.nonblank(lines), options.max_pages)
    modes = ln.page_writing_mode(shown)
    if options.writing_mode != "Auto":
        modes = modes.withColumn("writing_mode", F.lit(options.writing_mode))
    vertical = F.col("writing_mode") == "Vertical"
    j = shown.join(modes, PAGE).withColumn("box", F.struct(*"xywh"))
    boxes = {c: F.when(vertical, v).otherwise(F.col(c)) for c, v in zip("xywh", (F.col("y"), 1 - F.col("x") - F.col("w"), F.col("h"), F.col("w")))}
    turned = j.select(*PAGE, "line_no", *[v.alias(c) for c, v in boxes.items()], "box", "text", "conf", "source", "writing_mode")
    return columns.reading_order(turned).select(
        *PAGE, layout.block_id(F.col("page_no"), F.col("reading_order") + 1).alias("block_id"), "box.*", F.lit("Body").alias("type"), F.col("text").alias("ocr_text"), "conf", "source", "reading_order", (F.col("conf") < 0.85).alias("requires_review"), "writing_mode"
    )


def complete(blocks: DataFrame) -> DataFrame:
    """Columns that a block may lack."""
    for c, kind in (("corrected_text", "string"), ("related_block_id", "string"), ("image_path", "string"), ("heading_level", "int")):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(kind))
    for c in ("is_excluded", "is_edited"):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(False))
    return blocks


def reflow_blocks(lines: DataFrame, regions: DataFrame, merge: bool = True) -> DataFrame:
    """Typed blocks with figures and code, in reading order, captions linked and lines merged to paragraphs."""
    regions = layout.free_boxes(regions)
    code = layout.code_regions(lines, regions)
    typed = layout.classify(lines, regions).withColumn("part", F.lit(0)).withColumn("no", F.col("line_no"))
    fig = regions.filter("kind = 'Figure'").join(code.select(*PAGE, "region_no"), [*PAGE, "region_no"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    figures = fig.select(*PAGE, *"xywh", F.lit("").alias("text"), F.lit(1.0).alias("conf"), F.lit("Unknown").alias("source"), F.lit("Figure").alias("type"), none("int").alias("heading_level"), F.lit(False).alias("is_excluded"), F.lit(False).alias("requires_review"), F.lit(1).alias("part"), F.col("region_no").alias("no"))
    codes = code.select(*PAGE, *"xywh", "text", "conf", "source", F.lit("Code").alias("type"), none("int").alias("heading_level"), F.lit(False).alias("is_excluded"), (F.col("conf") < 0.85).alias("requires_review"), F.lit(2).alias("part"), F.col("region_no").alias("no"))
    everything = typed.drop("line_no").unionByName(figures).unionByName(codes).withColumn("item", F.format_string("%d-%09d", "part", "no"))
    ordered = columns.reading_order(everything, "item", by_x=False)
    blocks = ordered.withColumn("block_id", layout.block_id(F.col("page_no"), F.col("reading_order") + 1)).withColumnRenamed("text", "ocr_text").drop("part", "no", "item", "column_no")
    blocks = complete(layout.captions(blocks))
    return paragraphs.merge(blocks) if merge else blocks


def evaluate(lines: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_page = evaluation.page_evaluation(reflow_blocks(lines, regions))
    return per_page, evaluation.document_evaluation(lines.select(*PAGE).distinct(), per_page)


def with_models(blocks: DataFrame, label_answers: DataFrame | None = None, correction_answers: DataFrame | None = None) -> DataFrame:
    """Labels first, then corrections of what is left to correct."""
    if label_answers is not None:
        blocks = edits.apply_labels(blocks, edits.labels(label_answers, blocks))
    if correction_answers is not None:
        blocks = edits.apply_corrections(blocks, edits.corrections(correction_answers, blocks))
    return blocks


CSS = {False: "body{margin:5%}.caption{font-size:.9em}body.cover{margin:0}body.cover img{max-width:100%;max-height:100vh}", True: "body{margin:0;position:relative}img{position:absolute;width:100%;height:100%}span{position:absolute;color:transparent;white-space:pre}"}
#: Places in a book: fixed files, cover, chapters or pages, images.
COVER_POS, CHAPTER_POS, IMAGE_POS = 6, 10, 1_000_000


def _listed(files: DataFrame, spine: bool, cover: Column | bool = False) -> DataFrame:
    """Rows of the package document."""
    return files.select("doc_id", "pos", "path", F.lit(spine).alias("spine"), (cover if isinstance(cover, Column) else F.lit(cover)).alias("cover"))


def _assembled(projects: DataFrame, listed: DataFrame, nav: DataFrame, documents: DataFrame, fixed: bool) -> DataFrame:
    """(doc_id, pos, path, content) of a book's text files."""
    always = projects.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("nav.xhtml").alias("path")), F.struct(F.lit(2).alias("pos"), F.lit("style.css").alias("path")))).alias("f")).select("doc_id", "f.*")
    opf = markup.manifest(projects, _listed(always, False).unionByName(listed), fixed)
    row = lambda df, pos, path: df.select("doc_id", F.lit(pos).alias("pos"), F.lit(path).alias("path"), "content")
    css = projects.select("doc_id", F.lit(CSS[fixed]).alias("content"))
    container = projects.select("doc_id", F.lit('<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>').alias("content"))
    inside = row(opf, 3, "content.opf").unionByName(row(nav, 4, "nav.xhtml")).unionByName(row(css, 5, "style.css")).unionByName(documents.select("doc_id", "pos", "path", "content"))
    return row(container, 1, "META-INF/container.xml").unionByName(inside.withColumn("path", F.concat(F.lit("OEBPS/"), "path")))


def covers(pages: DataFrame) -> DataFrame:
    """(doc_id, image): the image of each document's first page, where it has one. pages: (doc_id, page_no, original_image, processed_image)."""
    shown = pg.display_images(pages)
    return shown.groupBy("doc_id").agg(F.min_by("display_image", "page_no").alias("image")).filter(~t.is_blank(F.coalesce("image", F.lit(""))))


def _inside(image: Column, name: Column | None = None) -> Column:
    """The path of an image in a book: its file's name, or the given one with its ending."""
    file = F.regexp_extract(image, r"([^/\\\\]*)$", 1)
    return F.concat(F.lit("images/"), file if name is None else F.concat(name, F.regexp_extract(image, r"(\.[^./\\\\]*)$", 1)))


def reflow_book(blocks: DataFrame, projects: DataFrame, fallback_title: str = "Front matter", pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, path, content): all text files of each reflowing book; the images of figures are listed. With pages, the first page's image is the cover of
    books that have one."""
    parts = ch.chapters(blocks, fallback_title)
    figures = blocks.withColumn("image_path", F.when(F.col("image_path").isNotNull(), F.concat(F.lit("../"), _inside(F.col("image_path")))))
    docs = markup.chapter_documents(parts, markup.elements(figures)).withColumn("pos", F.col("chapter_no") + CHAPTER_POS)
    listed = _listed(docs, True).unionByName(_listed(book_images(blocks), False))
    if pages is None:
        return _assembled(projects, listed, markup.navigation(parts, blocks), docs, False)
    first = covers(pages).join(projects.select("doc_id", "title", "language"), "doc_id").withColumn("image", _inside(F.col("image"), F.lit("cover")))
    body = F.concat(F.lit('<section epub:type="cover" xmlns:epub="http://www.idpf.org/2007/ops"><img src="'), t.escaped(F.col("image")), F.lit('" alt="'), t.escaped(F.col("title")), F.lit('"/></section>'))
    cover = first.select("doc_id", F.lit(COVER_POS).alias("pos"), F.lit("cover.xhtml").alias("path"), markup.page(F.col("title"), body, F.col("language"), F.lit('<link rel="stylesheet" type="text/css" href="style.css"/>'), "cover").alias("content"))
    listed = listed.unionByName(_listed(cover, True)).unionByName(_listed(cover_images(pages).join(projects.select("doc_id"), "doc_id"), False, True))
    nav = markup.navigation(parts, blocks, covered=first.select("doc_id"))
    return _assembled(projects, listed, nav, docs.select("doc_id", "pos", "path", "content").unionByName(cover), False)


def cover_images(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, path, image) of the covers."""
    return covers(pages).select("doc_id", F.lit(COVER_POS + 1).alias("pos"), _inside(F.col("image"), F.lit("cover")).alias("path"), "image")


def book_images(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, path, image): each figure's image once, under its path in the book."""
    found = pg.distinct_images(blocks.filter("type = 'Figure'"))
    return found.select("doc_id", (F.col("image_no") + IMAGE_POS).alias("pos"), _inside(F.col("image_path")).alias("path"), F.col("image_path").alias("image"))


def fixed_book(pages: DataFrame, blocks: DataFrame, projects: DataFrame) -> DataFrame:
    """(doc_id, pos, path, content): all text files of each fixed-layout book, a page of text over its image each. A project without pages is an error.

    pages: (doc_id, page_no, width, height, original_image, processed_image, writing_mode).
    """
    empty = projects.join(pages.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id").head(1)
    if empty:
        raise ValueError(f"a book of fixed layout needs pages; {empty[0].doc_id} has none")
    shown = page_images(pages)
    spans = markup.spans(blocks.drop("writing_mode", "width", "height").join(pages.select(*PAGE, "width", "height", "writing_mode"), PAGE))
    docs = markup.fixed_pages(shown.select(*PAGE, "width", "height", F.col("path").alias("image")), spans).withColumn("pos", F.col("page_no") * 2 + CHAPTER_POS)
    listed = _listed(docs, True).unionByName(_listed(shown, False))
    return _assembled(projects, listed, markup.page_list(pages.select(*PAGE)), docs, True)


def page_images(pages: DataFrame) -> DataFrame:
    """pages with pos, path and image: the image that is shown, numbered by page."""
    return pg.display_images(pages).withColumn("pos", F.col("page_no") * 2 + 1 + CHAPTER_POS).withColumn("path", _inside(F.col("display_image"), F.format_string("page-%04d", "page_no"))).withColumnRenamed("display_image", "image")


def with_images(files: DataFrame, images: DataFrame, contents: DataFrame) -> DataFrame:
    """files as bytes, with images (doc_id, pos, path, image) whose content is found under their path. contents: (path, content)."""
    c = contents.select(F.col("path").alias("image"), "content")
    held = images.join(c, "image").select("doc_id", "pos", F.concat(F.lit("OEBPS/"), "path").alias("path"), "content")
    return files.withColumn("content", F.encode("content", "utf-8")).unionByName(held)


def book_title(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first chapter title of each document."""
    return blocks.filter("type = 'ChapterTitle'").groupBy("doc_id").agg(F.min_by(t.title_text(F.col("corrected_text"), F.col("ocr_text")), F.struct("page_no", "reading_order")).alias("title"))
