"""Queries on regions, typed lines, blocks, captions, paragraphs, chapters and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chapters, evaluation, images, layout, pages, paragraphs
from ..plans import convert
from ..sources.tables import documents, lines_of, regions_of
from .line_queries import STATS, count_of, nonspace, ordered, sql

PAGE = ["doc_id", "page_no"]
AREA = "greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
IN = f"CASE WHEN l.w * l.h > 0 THEN {AREA.format(a='l', b='r')} / (l.w * l.h) ELSE 0 END > 0.5"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, d)
    return lines_of(docs), regions_of(docs)


def boxes(regions: DataFrame) -> DataFrame:
    """Figures and boxes moved over each other, for the overlap rule."""
    moved = regions.withColumn("kind", F.lit("Boxed")).withColumn("x", F.col("x") + 0.1 + F.col("doc_id") % 3 * 0.1).withColumn("region_no", F.lit(2))
    return regions.unionByName(moved)


def lines_in_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.contained(*_tables(spark, d)).select(*PAGE, "line_no", "region_kind")


def aside_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.contained(*_tables(spark, d), kind="Boxed", how="left_semi").select(*PAGE, "line_no")


def lines_outside_figures(spark: SparkSession, d: str) -> DataFrame:
    return layout.contained(*_tables(spark, d), kind="Figure", how="left_anti").select(*PAGE, "line_no")


def free_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.free_boxes(boxes(regions_of(documents(spark, d)))).select(*PAGE, "region_no", "kind")


BOXES = "v_boxes AS (SELECT * FROM v_regions UNION ALL SELECT doc_id, page_no, 2, x + 0.1 + doc_id % 3 * 0.1, y, w, h, 'Boxed' FROM v_regions)"


def code_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines that look like code in every tenth page's figure."""
    lines, regions = _tables(spark, d)
    code = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("if (x[0] == "), F.col("line_no").cast("string"), F.lit(") { y += *p; }"))).otherwise(F.col("text"))
    big = F.when(F.col("doc_id") % 10 == 0, 0.04).otherwise(F.col("h"))
    return lines.withColumn("text", code).withColumn("h", big), regions


def code_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.code_regions(*code_lines(spark, d)).select(*PAGE, "region_no", "text", "conf", "source")


CODE = f"""
SELECT doc_id, page_no, region_no, string_agg(text, chr(10) ORDER BY y, x, line_no) AS text, min(conf) AS conf, arg_min(source, (y, x, line_no)) AS source
FROM (SELECT l.*, r.region_no, r.w * r.h AS ra FROM (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN 'if (x[0] == ' || line_no || ') {{ y += *p; }}' ELSE text END AS text, CASE WHEN doc_id % 10 = 0 THEN 0.04::DOUBLE ELSE h END AS h) FROM v_lines) l
 JOIN v_regions r ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND r.kind = 'Figure' AND {IN})
GROUP BY doc_id, page_no, region_no, ra HAVING count(*) >= 2 AND sum(w * h) / ra >= 0.25 AND sum({nonspace('text')}) > 0 AND sum({count_of('text', t.CODE_SYMBOLS)})::DOUBLE / sum({nonspace('text')}) >= 0.05"""

FREE = f"v_free AS (SELECT * FROM v_lines l WHERE NOT EXISTS (SELECT 1 FROM v_regions r WHERE r.kind = 'Figure' AND l.doc_id = r.doc_id AND l.page_no = r.page_no AND {IN}))"
_core = f"regexp_replace(text, '{t.WS}', '', 'g')"
TYPED = f"""v_typed AS (SELECT *, CASE type WHEN 'ChapterTitle' THEN 1 WHEN 'SectionHeading' THEN 2 WHEN 'Subheading' THEN 3 END AS heading_level, type IN ('Header', 'Footer', 'PageNumber') AS is_excluded, conf < 0.85 AS requires_review FROM
 (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM v_regions r WHERE r.kind = 'Boxed' AND l.doc_id = r.doc_id AND l.page_no = r.page_no AND {IN}) THEN 'Aside'
   WHEN y + h > 0.94 AND length(text) <= 30 AND regexp_full_match(text, '\\p{{Nd}}*') THEN 'PageNumber' WHEN y < 0.06 AND length(text) <= 30 THEN 'Header' WHEN y + h > 0.94 AND length(text) <= 30 THEN 'Footer'
   WHEN ratio >= 1.8 AND y < 0.4 AND length(core) >= 3 AND regexp_matches(core, '^[\\p{{L}}\\p{{Nd}}]') AND NOT regexp_matches(core, '^\\p{{Nd}}*$') THEN 'ChapterTitle' WHEN ratio >= 1.8 THEN 'Decorative'
   WHEN ratio >= 1.35 THEN 'SectionHeading' WHEN ratio >= 1.15 THEN 'Subheading'
   WHEN length(text) <= 30 AND length(core) >= 4 AND ink >= 1.4 * body_ink AND ink < 3 * body_ink THEN 'Subheading' ELSE 'Body' END AS type
  FROM (SELECT f.*, {_core} AS core, body_ink, CASE WHEN body_h > 0 THEN h / body_h ELSE 1.0 END AS ratio FROM v_free f JOIN v_stats USING (doc_id, page_no)) l))"""
TYPES = (FREE, STATS.format("v_free"), TYPED)


def classified_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.classify(*_tables(spark, d)).select(*PAGE, "line_no", "type", F.coalesce("heading_level", F.lit(0)).alias("heading_level"), "is_excluded", "requires_review")


def fixed_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.fixed_blocks(lines_of(documents(spark, d))).select(*PAGE, "block_id", "reading_order", "requires_review", "ocr_text")


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Typed lines and figures as blocks in rows from the top, some edited or with images."""
    lines, regions = _tables(spark, d)
    typed = layout.classify(lines, regions, figures=True).withColumnRenamed("text", "ocr_text")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", "line_no")) - 1
    both = typed.withColumn("reading_order", order)
    return (
        both.withColumn("block_id", layout.block_id(F.col("page_no"), F.col("reading_order") + 1))
        .withColumn("corrected_text", F.when((F.col("type") != "Figure") & (F.col("reading_order") % 13 == 12), F.when(F.col("reading_order") % 2 == 0, F.concat("ocr_text", F.lit("!"))).otherwise("")))
        .withColumn("is_edited", F.col("reading_order") % 17 == 16).withColumn("image_path", F.when((F.col("type") == "Figure") & (F.col("doc_id") % 10 == 0), F.concat(F.lit("images/"), F.col("block_id"), F.lit(".jpg"))))
    )


BLOCKS = (*TYPES, """v_blocks AS (SELECT *, printf('p%04d-b%04d', page_no, reading_order + 1) AS block_id, CASE WHEN type <> 'Figure' AND reading_order % 13 = 12 THEN CASE WHEN reading_order % 2 = 0 THEN ocr_text || '!' ELSE '' END END AS corrected_text,
 reading_order % 17 = 16 AS is_edited, CASE WHEN type = 'Figure' AND doc_id % 10 = 0 THEN 'images/' || printf('p%04d-b%04d', page_no, reading_order + 1) || '.jpg' END AS image_path
 FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, line_no) - 1)::INT AS reading_order FROM
 (SELECT doc_id, page_no, line_no, x, y, w, h, text AS ocr_text, conf, source, type, heading_level, is_excluded, requires_review FROM v_typed
  UNION ALL SELECT doc_id, page_no, -1, x, y, w, h, '', 1.0, 'Unknown', 'Figure', NULL, false, false FROM v_regions WHERE kind = 'Figure')))""")


def caption_links(spark: SparkSession, d: str) -> DataFrame:
    return layout.captions(blocks_of(spark, d)).filter("related_block_id is not null").select("doc_id", "block_id", "related_block_id", "type")


_W = "(PARTITION BY doc_id, page_no ORDER BY reading_order)"
_lags = ", ".join(f"lag({c}, {k}) OVER {_W} AS {c}{k}" for k in (1, 2, 3) for c in ("x", "y", "w", "h", "type", "block_id"))


def _chain(k: int) -> str:
    at = lambda c, j: c if j == 0 else f"{c}{j}"
    parts = ["type = 'Body'", f"type{k} = 'Figure'"] + [f"type{j} = 'Body'" for j in range(1, k)]
    for j in range(k):
        parts.append(f"({at('y', j)} - ({at('y', j + 1)} + {at('h', j + 1)})) BETWEEN 0 AND 0.03")
        parts.append(f"least({at('x', j)} + {at('w', j)}, x{k} + w{k}) - greatest({at('x', j)}, x{k}) > 0")
    return " AND ".join(parts)


CAPTIONS = f"""SELECT * FROM (SELECT doc_id, block_id, CASE WHEN {_chain(1)} THEN block_id1 WHEN {_chain(2)} THEN block_id2 WHEN {_chain(3)} THEN block_id3 END AS related_block_id, 'Caption' AS type
 FROM (SELECT *, {_lags} FROM v_blocks)) WHERE related_block_id IS NOT NULL"""


def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Over lines in narrow steps, so that paragraphs form."""
    return paragraphs.merge(near(spark, d)).select(*PAGE, "block_id", "reading_order", "type", "n_lines", "ocr_text", "conf", "requires_review", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("w", 9).alias("w"), F.round("h", 9).alias("h"))


def near(spark: SparkSession, d: str) -> DataFrame:
    """The sixth line of every page starts with an initial; every thirteenth has no width."""
    b, n = blocks_of(spark, d), F.col("reading_order")
    b = b.withColumn("y", n * 22 / 1000.0).withColumn("x", F.when(n % 9 == 8, 0.1).otherwise(0.05)).withColumn("w", F.when(n % 13 == 11, 0.0).otherwise(0.4))
    return b.withColumn("ocr_text", F.when(n == 5, " W").otherwise(F.col("ocr_text"))).withColumn("h", F.when(n == 5, 0.06).otherwise(F.col("h"))).withColumn("x", F.when(n == 5, 0.01).otherwise(F.col("x")))


NEAR = """v_near AS (SELECT * REPLACE (reading_order * 22 / 1000.0::DOUBLE AS y, CASE WHEN reading_order = 5 THEN 0.01::DOUBLE WHEN reading_order % 9 = 8 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS x, CASE WHEN reading_order % 13 = 11 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS w,
 CASE WHEN reading_order = 5 THEN ' W' ELSE ocr_text END AS ocr_text, CASE WHEN reading_order = 5 THEN 0.06::DOUBLE ELSE h END AS h) FROM v_blocks)"""
_join = lambda a, b: f"CASE WHEN regexp_matches({a}, '[\\x{{21}}-\\x{{7E}}]$') AND regexp_matches({b}, '^[\\x{{21}}-\\x{{7E}}]') THEN ' ' ELSE '' END"
PARAS = f"""
SELECT doc_id, page_no, min(block_id) AS block_id, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY para) - 1)::INT AS reading_order, arg_min(type, reading_order) AS type, count(*) AS n_lines,
 string_agg(glue || ocr_text, '' ORDER BY reading_order) AS ocr_text, min(conf) AS conf, bool_or(requires_review) AS requires_review, round(min(x), 9) AS x, round(min(y), 9) AS y, round(max(x + w) - min(x), 9) AS w, round(max(y + h) - min(y), 9) AS h
FROM (SELECT *, CASE WHEN starts = 1 THEN '' ELSE {_join('prev_text', 'ocr_text')} END AS glue, sum(starts) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS para FROM
 (SELECT *, lag(ocr_text) OVER {_W} AS prev_text, CASE WHEN type IN ('Body', 'Aside') AND type = lag(type) OVER {_W} AND source = lag(source) OVER {_W} AND NOT is_excluded AND NOT lag(is_excluded) OVER {_W} AND NOT is_edited AND NOT lag(is_edited) OVER {_W}
   AND least(h, lag(h) OVER {_W}) > 0 AND (least(x + w, lag(x + w) OVER {_W}) - greatest(x, lag(x) OVER {_W})) / nullif(least(w, lag(w) OVER {_W}), 0) >= 0.5 AND greatest(h, lag(h) OVER {_W}) / least(h, lag(h) OVER {_W}) <= 1.4
   AND y - (lag(y) OVER {_W} + lag(h) OVER {_W}) >= -0.5 * least(h, lag(h) OVER {_W}) AND y - (lag(y) OVER {_W} + lag(h) OVER {_W}) <= 0.8 * least(h, lag(h) OVER {_W}) AND x - lag(x) OVER {_W} <= 0.9 * h THEN 0 ELSE 1 END AS starts
  FROM v_dropped)) GROUP BY doc_id, page_no, para"""


def drop_caps(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.drop_caps(capped(spark, d))


def capped(spark: SparkSession, d: str) -> DataFrame:
    """The first block of each page as a large initial."""
    b, first = blocks_of(spark, d), F.col("reading_order") == 0
    return b.withColumn("ocr_text", F.when(first, "A").otherwise(F.col("ocr_text"))).withColumn("h", F.when(first, 0.2).otherwise(F.col("h"))).withColumn("x", F.when(first, 0.01).otherwise(F.col("x"))).withColumn("is_excluded", F.when(first, False).otherwise(F.col("is_excluded")))


_len = f"length(regexp_replace(ocr_text, '^{t.WS}+|{t.WS}+$', '', 'g'))"
CAPS = f"""
SELECT doc_id, page_no, cap_id, target_id, regexp_replace(cap, '^{t.WS}+|{t.WS}+$', '', 'g') || ocr_text AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, cap_id ORDER BY y, reading_order) AS r FROM
 (SELECT c.doc_id, c.page_no, c.block_id AS cap_id, c.ocr_text AS cap, c.conf AS cap_conf, c.requires_review AS cap_review, l.block_id AS target_id, l.y, l.reading_order, l.ocr_text, l.is_edited FROM v_capped c
  JOIN (SELECT doc_id, page_no, percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC) AS uh FROM v_capped WHERE {_len} > 2 AND h > 0 GROUP BY ALL) u USING (doc_id, page_no)
  JOIN v_capped l ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND length(regexp_replace(l.ocr_text, '^{t.WS}+|{t.WS}+$', '', 'g')) > 2 AND NOT l.is_excluded AND least(l.y + l.h, c.y + c.h) - greatest(l.y, c.y) > 0 AND l.x >= c.x
  WHERE {_len.replace('ocr_text', 'c.ocr_text')} BETWEEN 1 AND 2 AND NOT c.is_excluded AND c.h >= 1.5 * uh)) WHERE r = 1 AND NOT is_edited"""
DROPPED = f"""v_cap_pairs AS (SELECT * FROM ({CAPS[CAPS.index('(SELECT *, row_number()') + 1 : CAPS.rindex(')) WHERE r = 1')].replace('v_capped', 'v_near')})) WHERE r = 1 AND NOT is_edited),
v_dropped AS (SELECT n.* REPLACE (coalesce(regexp_replace(p.cap, '^{t.WS}+|{t.WS}+$', '', 'g'), '') || n.ocr_text AS ocr_text, least(n.conf, coalesce(p.cap_conf, n.conf)) AS conf, n.requires_review OR coalesce(p.cap_review, false) AS requires_review)
 FROM v_near n LEFT JOIN v_cap_pairs p ON p.doc_id = n.doc_id AND p.page_no = n.page_no AND p.target_id = n.block_id WHERE NOT EXISTS (SELECT 1 FROM v_cap_pairs g WHERE g.doc_id = n.doc_id AND g.page_no = n.page_no AND g.cap_id = n.block_id))"""
CAPPED = "v_capped AS (SELECT * REPLACE (CASE WHEN reading_order = 0 THEN 'A' ELSE ocr_text END AS ocr_text, CASE WHEN reading_order = 0 THEN 0.2::DOUBLE ELSE h END AS h, CASE WHEN reading_order = 0 THEN 0.01::DOUBLE ELSE x END AS x, CASE WHEN reading_order = 0 THEN false ELSE is_excluded END AS is_excluded) FROM v_blocks)"


def books(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents' pages as one book."""
    return blocks_of(spark, d).withColumn("doc_id", F.floor(F.col("doc_id") / 10).cast("long"))


BOOKS = "v_books AS (SELECT * REPLACE (doc_id // 10 AS doc_id) FROM v_blocks)"


def chapter_segmentation(spark: SparkSession, d: str) -> DataFrame:
    out = chapters.chapters(books(spark, d))
    return out.select("doc_id", "chapter_no", "chapter_id", "title", F.size("block_ids").alias("n_blocks"), F.md5(F.array_join("block_ids", ",")).alias("blocks_md5"))


CHAPTERS = f"""
, rows_ AS (SELECT doc_id, block_id, type, CASE WHEN corrected_text IS NULL OR length(regexp_replace(corrected_text, '{t.WS}', '', 'g')) = 0 THEN ocr_text ELSE corrected_text END AS title,
 row_number() OVER (PARTITION BY doc_id ORDER BY page_no, reading_order, block_id) AS rn FROM v_books WHERE NOT is_excluded),
titles AS (SELECT doc_id, rn FROM rows_ WHERE type = 'ChapterTitle'),
acc AS (SELECT doc_id, min(rn) AS rn FROM titles GROUP BY doc_id UNION ALL SELECT a.doc_id, (SELECT min(t.rn) FROM titles t WHERE t.doc_id = a.doc_id AND t.rn >= a.rn + 4) FROM acc a WHERE EXISTS (SELECT 1 FROM titles t WHERE t.doc_id = a.doc_id AND t.rn >= a.rn + 4)),
parts AS (SELECT r.*, a.rn IS NOT NULL AS opens, count(a.rn) OVER (PARTITION BY r.doc_id ORDER BY r.rn ROWS UNBOUNDED PRECEDING) AS part FROM rows_ r LEFT JOIN acc a ON a.doc_id = r.doc_id AND a.rn = r.rn),
made AS (SELECT doc_id, part, coalesce(max(CASE WHEN opens THEN title END), 'Front matter') AS title, count(CASE WHEN NOT opens THEN 1 END)::INT AS n_blocks, md5(coalesce(string_agg(CASE WHEN NOT opens THEN block_id END, ',' ORDER BY rn), '')) AS blocks_md5 FROM parts GROUP BY ALL)
SELECT doc_id, chapter_no, printf('chapter-%03d', chapter_no) AS chapter_id, title, n_blocks, blocks_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part)::INT AS chapter_no FROM made)"""


def page_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.page_evaluation(blocks_of(spark, d))


def document_evaluation(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d)
    pages_ = documents(spark, d).select((F.col("doc_id") / 10).cast("long").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"))
    return evaluation.document_evaluation(pages_, evaluation.page_evaluation(b)).withColumn("coverage", F.round("coverage", 9)).withColumn("figure_rate", F.round("figure_rate", 9))


_n = nonspace("coalesce(corrected_text, ocr_text)")
_sums = f"""count(*) AS n_blocks, sum({_n})::BIGINT AS chars_total, sum(CASE WHEN NOT is_excluded THEN {_n} ELSE 0 END)::BIGINT AS chars_included, sum(CASE WHEN is_excluded THEN {_n} ELSE 0 END)::BIGINT AS chars_excluded, 0::BIGINT AS chars_dropped,
 count(CASE WHEN type = 'Figure' THEN 1 END) AS figures, count(CASE WHEN type = 'Figure' AND image_path IS NOT NULL THEN 1 END) AS figures_with_image, count(CASE WHEN type IN ('ChapterTitle', 'SectionHeading', 'Subheading') THEN 1 END) AS headings,
 count(CASE WHEN NOT is_excluded AND conf < 0.85 THEN 1 END) AS low_confidence"""
_cov = "CASE WHEN chars_total - chars_excluded <= 0 THEN 1.0 ELSE chars_included::DOUBLE / (chars_total - chars_excluded) END"
PAGE_EVAL = f"SELECT *, {_cov} AS coverage FROM (SELECT doc_id, page_no, {_sums} FROM v_blocks GROUP BY doc_id, page_no)"
DOC_EVAL = f"""SELECT *, round({_cov}, 9) AS coverage, round(CASE WHEN figures = 0 THEN 1.0 ELSE figures_with_image::DOUBLE / figures END, 9) AS figure_rate FROM
 (SELECT doc_id, pages, pages_with_blocks, * EXCLUDE (doc_id, pages, pages_with_blocks) FROM (SELECT doc_id // 10 AS doc_id, count(*) AS pages FROM documents GROUP BY 1) JOIN (SELECT doc_id, count(DISTINCT page_no) AS pages_with_blocks, {_sums} FROM v_books GROUP BY doc_id) USING (doc_id))"""


def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = evaluation.type_histogram(blocks_of(spark, d))
    return h.select(*PAGE, F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("types"))


_ord = "CASE type " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(t.BLOCK_TYPES)) + " END"
HISTOGRAM = f"SELECT doc_id, page_no, string_agg(type || '=' || n, ',' ORDER BY {_ord}) AS types FROM (SELECT doc_id, page_no, type, count(*) AS n FROM v_blocks GROUP BY ALL) GROUP BY doc_id, page_no"


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    pages_ = documents(spark, d).select((F.col("doc_id") / 10).cast("long").alias("doc_id"), F.col("doc_id").cast("int").alias("page_no"))
    return pages.source_counts(pages_, books(spark, d))


COUNTS = """SELECT doc_id, count(CASE WHEN pdf THEN 1 END) AS pdf_pages, count(CASE WHEN ocr THEN 1 END) AS ocr_pages, count(CASE WHEN coalesce(unknown, true) THEN 1 END) AS unknown_pages, coalesce(sum(review), 0)::BIGINT AS review_blocks, coalesce(sum(edited), 0)::BIGINT AS edited_blocks FROM
 (SELECT doc_id // 10 AS doc_id, doc_id::INT AS page_no FROM documents) LEFT JOIN (SELECT doc_id, page_no, bool_or(source = 'PdfTextLayer') AS pdf, bool_or(source = 'Ocr') AS ocr, bool_and(source = 'Unknown') AS unknown, count(CASE WHEN requires_review THEN 1 END) AS review, count(CASE WHEN is_edited THEN 1 END) AS edited FROM v_books GROUP BY ALL) USING (doc_id, page_no) GROUP BY doc_id"""


def reflow_plan(spark: SparkSession, d: str) -> DataFrame:
    lines, regions = _tables(spark, d)
    return convert.reflow_blocks(lines, regions).select(*PAGE, "block_id", "type", "reading_order", "related_block_id", "n_lines", "ocr_text")


def upright(lines: DataFrame) -> DataFrame:
    """Every seventh page set in columns from right to left."""
    turned = F.col("doc_id") % 7 == 0
    boxes = {"x": 1 - F.col("y") - F.col("h"), "y": F.col("x"), "w": F.col("h"), "h": F.col("w")}
    return lines.select(*[F.when(turned, boxes[c]).otherwise(F.col(c)).alias(c) if c in boxes else c for c in lines.columns])


def fixed_plan(spark: SparkSession, d: str) -> DataFrame:
    return convert.fixed_blocks(upright(lines_of(documents(spark, d)))).select(*PAGE, "block_id", "reading_order", "ocr_text", "writing_mode")


_v = "writing_mode = 'Vertical'"
FIXED = (
    f"v_up AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 1 - y - h ELSE x END AS x, CASE WHEN doc_id % 7 = 0 THEN x ELSE y END AS y, CASE WHEN doc_id % 7 = 0 THEN h ELSE w END AS w, CASE WHEN doc_id % 7 = 0 THEN w ELSE h END AS h) FROM v_lines WHERE {nonspace('text')} > 0)",
    f"v_upmodes AS (SELECT doc_id, page_no, CASE WHEN sum(CASE WHEN n >= 2 AND h > 1.5 * w THEN n ELSE 0 END) > sum(CASE WHEN n >= 2 AND w > 1.5 * h THEN n ELSE 0 END) THEN 'Vertical' ELSE 'Horizontal' END AS writing_mode FROM (SELECT *, {nonspace('text')} AS n FROM v_up) GROUP BY ALL)",
    f"v_flat AS (SELECT * REPLACE (CASE WHEN {_v} THEN y ELSE x END AS x, CASE WHEN {_v} THEN 1 - x - w ELSE y END AS y, CASE WHEN {_v} THEN h ELSE w END AS w, CASE WHEN {_v} THEN w ELSE h END AS h) FROM v_up JOIN v_upmodes USING (doc_id, page_no))",
    ordered("v_flat", "v_fixed", "line_no"),
)
REFLOW = (
    """v_ritems AS (SELECT doc_id, page_no, printf('0-%09d', line_no) AS item, x, y, w, h, text AS ocr_text, conf, source, type, heading_level, is_excluded, requires_review FROM v_typed
 UNION ALL SELECT doc_id, page_no, printf('1-%09d', region_no), x, y, w, h, '', 1.0, 'Unknown', 'Figure', NULL, false, false FROM v_regions WHERE kind = 'Figure')""",
    ordered("v_ritems", "v_rorder", "item", by_x=False),
    "v_rblocks AS (SELECT *, printf('p%04d-b%04d', page_no, reading_order + 1) AS block_id, false AS is_edited FROM v_rorder)",
    f"v_rlinked AS (SELECT * REPLACE (CASE WHEN related_block_id IS NOT NULL THEN 'Caption' ELSE type END AS type) FROM (SELECT *, CASE WHEN {_chain(1)} THEN block_id1 WHEN {_chain(2)} THEN block_id2 WHEN {_chain(3)} THEN block_id3 END AS related_block_id FROM (SELECT *, {_lags} FROM v_rblocks)))",
    DROPPED.replace("v_near", "v_rlinked"),
)
REFLOWED = f"SELECT doc_id, page_no, block_id, type, reading_order, related_block_id, n_lines, ocr_text FROM ({PARAS.replace('count(*) AS n_lines', 'count(*) AS n_lines, arg_min(related_block_id, reading_order) AS related_block_id')})"


def overlay_boxes(spark: SparkSession, d: str) -> DataFrame:
    return images.overlay_boxes(blocks_of(spark, d))


def _clip(a: str, s: str, size: int) -> str:
    start = f"least(greatest(0, trunc({a} * {size})::INT), {size - 1})"
    return f"{start} AS {{}}, least(greatest(1, trunc({s} * {size})::INT), {size} - {start}) AS {{}}"


_hex = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in images.COLOURS.items()) + " END"
OVERLAY = f"""SELECT doc_id, page_no, block_id, {_clip('x', 'w', 1200).format('"left"', 'wide')}, {_clip('y', 'h', 1600).format('top', 'high')}, ('0x' || substr({_hex}, 2, 2))::INT AS r, ('0x' || substr({_hex}, 4, 2))::INT AS g, ('0x' || substr({_hex}, 6, 2))::INT AS b,
 CASE WHEN is_excluded THEN 1 ELSE 3 END AS thickness, reading_order || ' ' || type AS label FROM v_blocks"""

LAYOUT = {
    "lines_in_regions": (lines_in_regions, sql(f"SELECT l.doc_id, l.page_no, l.line_no, r.kind AS region_kind FROM v_lines l JOIN v_regions r ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND {IN}")),
    "aside_lines": (aside_lines, sql(f"SELECT doc_id, page_no, line_no FROM v_lines l WHERE EXISTS (SELECT 1 FROM v_regions r WHERE r.kind = 'Boxed' AND l.doc_id = r.doc_id AND l.page_no = r.page_no AND {IN})")),
    "lines_outside_figures": (lines_outside_figures, sql("SELECT doc_id, page_no, line_no FROM v_free", FREE)),
    "free_boxes": (free_boxes, sql(f"SELECT doc_id, page_no, region_no, kind FROM v_boxes l WHERE kind = 'Figure' OR NOT EXISTS (SELECT 1 FROM v_boxes r WHERE r.kind = 'Figure' AND l.doc_id = r.doc_id AND l.page_no = r.page_no AND {AREA.format(a='l', b='r')} / least(l.w * l.h, r.w * r.h) > 0.5)", BOXES)),
    "code_regions": (code_regions, sql(CODE)),
    "classified_lines": (classified_lines, sql("SELECT doc_id, page_no, line_no, type, coalesce(heading_level, 0) AS heading_level, is_excluded, requires_review FROM v_typed", *TYPES)),
    "fixed_blocks": (fixed_blocks, sql(f"SELECT doc_id, page_no, printf('p%04d-b%04d', page_no, rn) AS block_id, (rn - 1)::INT AS reading_order, conf < 0.85 AS requires_review, text AS ocr_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, line_no) AS rn FROM v_lines WHERE {nonspace('text')} > 0)")),
    "caption_links": (caption_links, sql(CAPTIONS, *BLOCKS)),
    "paragraph_merge": (paragraph_merge, sql(PARAS, *BLOCKS, NEAR, DROPPED)),
    "drop_caps": (drop_caps, sql(CAPS, *BLOCKS, CAPPED)),
    "chapter_segmentation": (chapter_segmentation, sql(CHAPTERS, *BLOCKS, BOOKS).replace("WITH ", "WITH RECURSIVE ", 1)),
    "page_evaluation": (page_evaluation, sql(PAGE_EVAL, *BLOCKS)),
    "document_evaluation": (document_evaluation, sql(DOC_EVAL, *BLOCKS, BOOKS)),
    "type_histogram": (type_histogram, sql(HISTOGRAM, *BLOCKS)),
    "source_counts": (source_counts, sql(COUNTS, *BLOCKS, BOOKS)),
    "overlay_boxes": (overlay_boxes, sql(OVERLAY, *BLOCKS)),
    "reflow_plan": (reflow_plan, sql(REFLOWED, *TYPES, *REFLOW)),
    "fixed_plan": (fixed_plan, sql("SELECT doc_id, page_no, printf('p%04d-b%04d', page_no, reading_order + 1) AS block_id, reading_order, text AS ocr_text, writing_mode FROM v_fixed", *FIXED)),
}
