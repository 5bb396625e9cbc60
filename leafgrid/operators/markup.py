"""Documents of an e-book as strings: chapters, fixed pages, package and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def element(kind: Column, block_id: Column, text: Column) -> Column:
    """A block's element by its type."""
    e = t.escaped(text)
    heading = lambda n: F.concat(F.lit(f'<h{n} id="'), block_id, F.lit('">'), e, F.lit(f"</h{n}>"))
    around = lambda a, b: F.concat(F.lit(a), e, F.lit(b))
    return (
        F.when(kind == "ChapterTitle", heading(1)).when(kind == "SectionHeading", heading(2)).when(kind == "Subheading", heading(3)).when(kind == "Caption", around('<p class="caption">', "</p>"))
        .when(kind == "Aside", around('<aside class="sidebar"><p>', "</p></aside>")).when(kind == "Footnote", around('<aside class="footnote"><p>', "</p></aside>")).when(kind == "PullQuote", around("<blockquote><p>", "</p></blockquote>"))
        .when(kind == "Code", around("<pre><code>", "</code></pre>")).otherwise(around("<p>", "</p>"))
    )


def elements(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, reading_order, block_id, html): figures with their captions, captions of figures left out, other blocks unless blank.

    blocks also has related_block_id and image_path. A caption goes with its figure even if the figure is excluded.
    """
    b = blocks.withColumn("text", t.effective(F.col("corrected_text"), F.col("ocr_text")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "reading_order", "text"))), lambda s: s["text"])
    caps = b.filter("related_block_id is not null").groupBy("doc_id", F.col("related_block_id").alias("block_id")).agg(texts.alias("captions"))
    shown = b.filter("related_block_id is null and not is_excluded").join(caps, ["doc_id", "block_id"], "left")
    alt = t.escaped(F.coalesce(F.try_element_at("captions", F.lit(1)), F.lit("Figure")))
    img = F.when(F.col("image_path").isNotNull(), F.concat(F.lit('<img src="'), t.escaped(F.col("image_path")), F.lit('" alt="'), alt, F.lit('"/>'))).otherwise("")
    cap = F.when(F.size("captions") > 0, F.concat(F.lit("<figcaption>"), t.escaped(F.array_join("captions", "")), F.lit("</figcaption>"))).otherwise("")
    figure = F.concat(F.lit("<figure>"), img, cap, F.lit("</figure>"))
    html = F.when(F.col("type") == "Figure", figure).otherwise(element(F.col("type"), F.col("block_id"), F.col("text")))
    return shown.filter((F.col("type") == "Figure") | ~t.is_blank(F.col("text"))).select("doc_id", "page_no", "reading_order", "block_id", html.alias("html"))


def _listed(chapters: DataFrame, *more: str) -> DataFrame:
    """A row for each block of a chapter, or one if it has none; the first has the title, which may be long and needn't travel with all."""
    listed = chapters.select("doc_id", "chapter_no", "title", *more, F.posexplode_outer("block_ids").alias("pos", "block_id"))
    return listed.withColumn("title", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("title")))


def chapter_documents(chapters: DataFrame, made: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, chapter_no, path, content): each chapter's heading and elements in the order of its block_ids; unknown ids are skipped."""
    listed = _listed(chapters, "heading_level")
    joined = listed.join(made.select("doc_id", "block_id", "html"), ["doc_id", "block_id"], "left").groupBy("doc_id", "chapter_no", "heading_level")
    body = joined.agg(F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda s: s["html"]), "\n").alias("body"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("heading_level"))).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(">"), t.escaped(F.col("title")), F.lit("</h"), level, F.lit(">"))
    return body.select("doc_id", "chapter_no", F.format_string("chapters/chapter-%03d.xhtml", "chapter_no").alias("path"), page(F.col("title"), F.concat(head, F.lit("\n"), F.col("body")), language).alias("content"))


def page(title: Column, body: Column, language: str | Column, head: Column | None = None, kind: str = "") -> Column:
    lang = F.lit(language) if isinstance(language, str) else language
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), lang, F.lit('"><head><title>'), t.escaped(title), F.lit("</title>"), head if head is not None else F.lit(""), F.lit(f'</head><body class="{kind}">' if kind else "</head><body>"), body, F.lit("</body></html>")
    )


def spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, reading_order, y, x, span): text placed over a page image. blocks also has width, height (points) and writing_mode of the page."""
    text = t.effective(F.col("corrected_text"), F.col("ocr_text"))
    ratio = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    left, top = ratio("x") * F.col("width"), ratio("y") * F.col("height")
    w, h = F.greatest(F.lit(1.0), ratio("w") * F.col("width")), F.greatest(F.lit(1.0), ratio("h") * F.col("height"))
    vertical = (F.col("writing_mode") == "Vertical") & (h > 1.5 * w)
    size = 0.85 * F.least(w, h)
    natural = t.natural_width(text) * size
    scale = F.when(natural > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.when(vertical, h).otherwise(w) / natural))).otherwise(1.0)
    px = lambda name, v: F.concat(F.lit(f"{name}:"), t.number(v), F.lit("px"))
    axis = F.when(vertical, "scaleY(").otherwise("scaleX(")
    squeeze = F.when(F.abs(scale - 1) > 0.02, F.concat(F.lit("transform:"), axis, t.number(scale), F.lit(")")))
    style = F.concat_ws(";", px("left", left), px("top", top), px("width", w), px("height", h), px("font-size", size), F.when(vertical, F.lit("writing-mode:vertical-rl")), squeeze)
    span = F.concat(F.lit('<span data-source="'), t.source_name(F.col("source")), F.lit('" style="'), style, F.lit('">'), t.escaped(text), F.lit("</span>"))
    return blocks.filter(~F.col("is_excluded") & ~t.is_blank(text)).select("doc_id", "page_no", "reading_order", "y", "x", span.alias("span"))


def fixed_pages(pages: DataFrame, made: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, page_no, path, content): pages (doc_id, page_no, width, height, image) with their spans by order, y, x."""
    body = made.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "y", "x", "span"))), lambda s: s["span"]), "").alias("spans"))
    j = pages.join(body, ["doc_id", "page_no"], "left")
    view = F.concat(F.lit('<meta name="viewport" content="width='), F.col("width").cast("string"), F.lit(", height="), F.col("height").cast("string"), F.lit('"/>'))
    image = F.concat(F.lit('<img src="../'), t.escaped(F.col("image")), F.lit('" alt=""/>'))
    return j.select("doc_id", "page_no", F.format_string("pages/page-%04d.xhtml", "page_no").alias("path"), page(F.format_string("Page %d", "page_no"), F.concat(image, F.coalesce("spans", F.lit(""))), language, view).alias("content"))


def manifest(projects: DataFrame, files: DataFrame, fixed: bool = False, modified: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(doc_id, content): the package document. projects: (doc_id, title, author, publisher, language, writing_mode, project_id); files: (doc_id, pos, path, spine, cover)."""
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    media = F.when(F.col("path").endswith(".xhtml"), "application/xhtml+xml").when(F.col("path").endswith(".css"), "text/css").otherwise(t.media_type(F.col("path")))
    props = F.when(F.col("cover"), ' properties="cover-image"').when(F.col("path") == "nav.xhtml", ' properties="nav"').otherwise("")
    item = F.concat(F.lit('<item id="'), name, F.lit('" href="'), F.col("path"), F.lit('" media-type="'), media, F.lit('"'), props, F.lit("/>"))
    ref = F.when(F.col("spine"), F.concat(F.lit('<itemref idref="'), name, F.lit('"/>')))
    grouped = files.select("doc_id", "pos", item.alias("item"), ref.alias("ref")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "ref"))).alias("f"))
    tag = lambda n, c: F.when(~t.is_blank(F.col(c)), F.concat(F.lit(f"<dc:{n}>"), t.escaped(F.col(c)), F.lit(f"</dc:{n}>"))).otherwise("")
    layout = F.lit('<meta property="rendition:layout">pre-paginated</meta>' if fixed else "")
    direction = F.concat(F.lit(' page-progression-direction="'), F.when(F.col("writing_mode") == "Vertical", "rtl").otherwise("ltr"), F.lit('"')) if fixed else F.lit("")
    j = projects.join(grouped, "doc_id")
    return j.select("doc_id", F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">'), F.col("project_id"), F.lit("</dc:identifier>"),
        tag("title", "title"), tag("language", "language"), tag("creator", "author"), tag("publisher", "publisher"), F.lit(f'<meta property="dcterms:modified">{modified}</meta>'), layout, F.lit("</metadata><manifest>"),
        F.array_join(F.transform("f", lambda s: s["item"]), ""), F.lit("</manifest><spine"), direction, F.lit(">"), F.array_join(F.filter(F.transform("f", lambda s: s["ref"]), lambda r: r.isNotNull()), ""), F.lit("</spine></package>"),
    ).alias("content"))


def navigation(chapters: DataFrame, blocks: DataFrame, language: str = "en", covered: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): chapters, and in each the section headings that have text (no lower ones); the cover first for the documents of covered."""
    listed = _listed(chapters)
    text = t.effective(F.col("corrected_text"), F.col("ocr_text"))
    sections = blocks.filter((F.col("type") == "SectionHeading") & ~t.is_blank(text)).select("doc_id", "block_id", text.alias("section"))
    href = F.format_string("chapters/chapter-%03d.xhtml", "chapter_no")
    entry = F.when(F.col("section").isNotNull(), F.struct("pos", F.concat(F.lit('<li><a href="'), href, F.lit("#"), F.col("block_id"), F.lit('">'), t.escaped(F.col("section")), F.lit("</a></li>")).alias("li")))
    per = listed.join(sections, ["doc_id", "block_id"], "left").groupBy("doc_id", "chapter_no").agg(F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["li"]), "").alias("subs"))
    inner = F.when(F.length("subs") > 0, F.concat(F.lit("<ol>"), F.col("subs"), F.lit("</ol>"))).otherwise("")
    li = F.concat(F.lit('<li><a href="'), href, F.lit('">'), t.escaped(F.col("title")), F.lit("</a>"), inner, F.lit("</li>"))
    listing = per.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", li.alias("li")))), lambda s: s["li"]), "").alias("lis"))
    first = F.lit("")
    if covered is not None:
        listing = listing.join(covered.select("doc_id", F.lit(True).alias("_covered")), "doc_id", "left")
        first = F.when(F.col("_covered"), '<li><a href="cover.xhtml">Cover</a></li>').otherwise("")
    return listing.select("doc_id", page(F.lit("Contents"), F.concat(F.lit('<nav epub:type="toc" xmlns:epub="http://www.idpf.org/2007/ops"><ol>'), first, F.col("lis"), F.lit("</ol></nav>")), language).alias("content"))


def page_list(pages: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, content): navigation of a fixed layout, one entry of contents and the list of pages."""
    w = Window.partitionBy("doc_id")
    j = pages.select("doc_id", "page_no", F.min("page_no").over(w).alias("first"))
    li = F.concat(F.format_string('<li><a href="pages/page-%04d.xhtml">', "page_no"), F.col("page_no").cast("string"), F.lit("</a></li>"))
    g = j.groupBy("doc_id", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", li.alias("li")))), lambda s: s["li"]), "").alias("lis"))
    toc = F.concat(F.lit('<nav epub:type="toc" xmlns:epub="http://www.idpf.org/2007/ops"><ol><li><a href="'), F.format_string("pages/page-%04d.xhtml", "first"), F.lit('">Start</a></li></ol></nav><nav epub:type="page-list" xmlns:epub="http://www.idpf.org/2007/ops"><ol>'))
    return g.select("doc_id", page(F.lit("Pages"), F.concat(toc, F.col("lis"), F.lit("</ol></nav>")), language).alias("content"))
