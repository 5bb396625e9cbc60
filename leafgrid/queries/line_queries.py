"""Queries on lines: filters, writing mode, language, text layers, columns, body statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import columns, layout, lines, pages
from ..sources.tables import SQL_VIEWS, documents, lines_of, regions_of

PAGE = ["doc_id", "page_no"]


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def nonspace(c: str) -> str:
    return f"length(regexp_replace({c}, '{t.WS}', '', 'g'))"


def count_of(c: str, pattern: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '{q(pattern)}', '', 'g')))"


def sql(body: str, *views: str) -> str:
    return "WITH " + ", ".join([SQL_VIEWS.strip(), *views]) + "\n" + body


KEEP = f"""(source <> 'Ocr' OR (conf >= 0.6 AND (conf >= 0.85 OR (CASE WHEN {nonspace('text')} > 0 THEN {count_of('text', r'[\p{L}\p{Nd}]')}::DOUBLE / {nonspace('text')} ELSE 0 END >= 0.5
 AND NOT regexp_matches(regexp_replace(text, '{t.WS}', '', 'g'), '[0-9]{{16}}')))))"""


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_metadata(documents(spark, d).select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("raw_text")))


def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.nonblank(lines_of(documents(spark, d))).select("doc_id", "line_no", "text")


def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    return lines.junk_filter(lines_of(documents(spark, d))).select("doc_id", "line_no", "conf")


def junk_counts(spark: SparkSession, d: str) -> DataFrame:
    return lines.junk_counts(lines_of(documents(spark, d)))


def page_writing_mode(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_writing_mode(tall(spark, d))


def tall(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every seventh page turned upright."""
    turned = F.col("doc_id") % 7 == 0
    return lines_of(documents(spark, d)).select("doc_id", "page_no", "text", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("w"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("h"))


TALL = "v_tall AS (SELECT doc_id, page_no, text, CASE WHEN doc_id % 7 = 0 THEN h ELSE w END AS w, CASE WHEN doc_id % 7 = 0 THEN w ELSE h END AS h FROM v_lines)"
MODES = f"""v_modes AS (SELECT doc_id, page_no, CASE WHEN sum(CASE WHEN n >= 2 AND h > 1.5 * w THEN n ELSE 0 END) > sum(CASE WHEN n >= 2 AND w > 1.5 * h THEN n ELSE 0 END) THEN 'Vertical' ELSE 'Horizontal' END AS writing_mode
 FROM (SELECT *, {nonspace('text')} AS n FROM v_tall) GROUP BY ALL)"""


def document_writing_mode(spark: SparkSession, d: str) -> DataFrame:
    """With ten documents' pages as one document."""
    modes = lines.page_writing_mode(tall(spark, d))
    return lines.document_writing_mode(modes.select((F.col("doc_id") / 10).cast("long").alias("doc_id"), "writing_mode"))


def document_language(spark: SparkSession, d: str) -> DataFrame:
    return lines.language(documents(spark, d).select("doc_id", "text"))


CJK_ROWS = [(1, "これは日本語のぶんしょうです。かなと漢字がまざっています。"), (1, "もうひとつのぎょうがここにあります。ながさをたりるようにします。"), (2, "这是一个中文句子用来测试语言检测功能是否正常工作并且足够长"), (2, "第二行文字继续补充内容直到超过五十个字符的门槛为止没有问题"), (3, "이것은 한국어 문장입니다 언어 감지를 시험하기 위한 것입니다"), (3, "두 번째 줄도 충분히 길어야 오십 글자를 넘을 수 있습니다 그렇죠 정말로 그렇습니다"), (4, "This is English text that is long enough to be counted as such by the rule"), (5, "abc")]


def script_language(spark: SparkSession, d: str) -> DataFrame:
    return lines.language(spark.createDataFrame(CJK_ROWS, "doc_id long, text string"))


def _language(source: str) -> str:
    total = "(kana + hangul + ideo + latin)"
    return f"""SELECT doc_id, kana, hangul, ideo, latin, CASE WHEN {total} < 50 THEN 'ja' WHEN kana * 100 >= {total} * 5 THEN 'ja' WHEN hangul * 100 >= {total} * 30 THEN 'ko' WHEN ideo * 100 >= {total} * 30 THEN 'zh' ELSE 'en' END AS language
FROM (SELECT doc_id, sum({count_of('text', t.KANA)})::BIGINT AS kana, sum({count_of('text', t.HANGUL)})::BIGINT AS hangul, sum({count_of('text', t.IDEOGRAPH)})::BIGINT AS ideo, sum({count_of('text', '[A-Za-z]')})::BIGINT AS latin FROM {source} GROUP BY doc_id)"""


def layer_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    raw = docs.select("doc_id", F.col("doc_id").cast("int").alias("page_no"), F.when(F.col("doc_id") % 6 == 0, F.repeat("text", 3)).otherwise(F.col("text")).alias("raw_text"))
    return lines.layer_quality(raw, lines_of(docs))


def need_ocr(spark: SparkSession, d: str) -> DataFrame:
    return pages.need_ocr(layer_quality(spark, d))


QUALITY = f"""v_quality AS (SELECT *, reason = 'usable' AS usable FROM (SELECT doc_id, page_no, raw_chars, positioned, round(coverage, 6) AS coverage,
 CASE WHEN raw_chars = 0 THEN 'no text' WHEN positioned = 0 THEN 'no positions' WHEN coverage < 0.5 THEN 'low coverage' WHEN invalid > 0.02 * positioned THEN 'invalid characters' WHEN private > 0.2 * positioned THEN 'private characters'
  WHEN bad > 0.1 * n_lines THEN 'bad bounds' ELSE 'usable' END AS reason
 FROM (SELECT doc_id, page_no, raw_chars, coalesce(positioned, 0) AS positioned, invalid, private, bad, n_lines, CASE WHEN raw_chars > 0 THEN least(1.0, coalesce(positioned, 0) / raw_chars::DOUBLE) ELSE 0.0 END AS coverage
  FROM (SELECT doc_id, doc_id::INT AS page_no, {nonspace("CASE WHEN doc_id % 6 = 0 THEN text || text || text ELSE text END")} AS raw_chars FROM documents)
  LEFT JOIN (SELECT doc_id, sum({nonspace('text')})::BIGINT AS positioned, sum({count_of('text', t.INVALID)}) AS invalid, sum({count_of('text', t.PRIVATE)}) AS private, count(*) AS n_lines,
   count_if(NOT (x >= -0.01 AND y >= -0.01 AND w > 0 AND h > 0 AND x + w <= 1.01 AND y + h <= 1.01)) AS bad FROM v_lines GROUP BY doc_id) USING (doc_id))))"""


def body_statistics(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_stats(lines_of(documents(spark, d)))


STATS = "v_stats AS (SELECT doc_id, page_no, percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC) AS body_h, CASE WHEN count(ink) >= 5 THEN percentile_disc(0.5) WITHIN GROUP (ORDER BY ink DESC) END AS body_ink FROM {} GROUP BY doc_id, page_no)"


def gutter_search(spark: SparkSession, d: str) -> DataFrame:
    found = columns.gutters(lines_of(documents(spark, d)))
    return found.select(*PAGE, F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


_xs = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(columns.positions(0.0, 1.0)))
GUTTERS = f"""
SELECT doc_id, page_no, round(s, 9) AS start, round(e, 9) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY e - s DESC, s) AS r FROM
 (SELECT doc_id, page_no, min(gx) AS s, max(gx) AS e FROM (SELECT *, step - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY step) AS island FROM
  (SELECT doc_id, page_no, step, gx, count(*) AS n, count_if(x < gx AND x + w > gx) AS crossing, count_if(w <= 0.5) AS narrow, count_if(w <= 0.5 AND x < gx AND x + w > gx) AS nc,
    count_if(w <= 0.5 AND NOT (x < gx AND x + w > gx) AND x + w / 2 < gx) AS nl, count_if(w <= 0.5 AND NOT (x < gx AND x + w > gx) AND NOT x + w / 2 < gx) AS nr
   FROM v_lines CROSS JOIN (VALUES {_xs}) AS g(step, gx) GROUP BY ALL)
  WHERE n >= 4 AND narrow >= 4 AND crossing <= n * 0.35 AND nc <= greatest(2, floor(narrow * 0.08)) AND least(nl, nr) >= 2 AND least(nl, nr) >= (nl + nr) * 0.05) GROUP BY doc_id, page_no, island)) WHERE r = 1"""


def ordered(source: str, name: str, number: str, by_x: bool = True) -> str:
    """SQL views that order a page's items by columns where at most one gutter, in the middle, can be found, as on these pages."""
    crosses = "(x < 0.5 AND x + w > 0.5)"
    return f"""{name}_sides AS (SELECT *, CASE WHEN n >= 4 AND narrow >= 4 AND crossing <= n * 0.35 AND nc <= greatest(2, floor(narrow * 0.08)) AND least(nl, nr) >= 2 AND least(nl, nr) >= (nl + nr) * 0.05 THEN CASE WHEN x + w / 2 < 0.5 THEN 1 ELSE 2 END ELSE 0 END AS side FROM
 (SELECT *, count(*) OVER p AS n, count_if(w <= 0.5) OVER p AS narrow, count_if({crosses}) OVER p AS crossing, count_if(w <= 0.5 AND {crosses}) OVER p AS nc, count_if(w <= 0.5 AND NOT {crosses} AND x + w / 2 < 0.5) OVER p AS nl, count_if(w <= 0.5 AND NOT {crosses} AND NOT x + w / 2 < 0.5) OVER p AS nr
  FROM {source} WINDOW p AS (PARTITION BY doc_id, page_no))),
{name}_groups AS (SELECT doc_id, page_no, side, min(y) AS top, max(y + h) AS bottom FROM {name}_sides GROUP BY ALL),
{name}_late AS (SELECT doc_id, page_no, NOT least(l.bottom, r.bottom) - greatest(l.top, r.top) > 0.5 * least(l.bottom - l.top, r.bottom - r.top) AND l.top > r.top AS late FROM {name}_groups l JOIN {name}_groups r USING (doc_id, page_no) WHERE l.side = 1 AND r.side = 2),
{name} AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY column_no, y, {'x, ' if by_x else ''}{number}) - 1)::INT AS reading_order FROM
 (SELECT s.*, (CASE WHEN side = 0 THEN 0 WHEN coalesce(late, false) THEN 2 - side ELSE side - 1 END)::INT AS column_no FROM {name}_sides s LEFT JOIN {name}_late USING (doc_id, page_no)))"""


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return columns.reading_order(lines.nonblank(lines_of(documents(spark, d)))).select(*PAGE, "line_no", "column_no", "reading_order")


def first_pages(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents' pages as one document, of which the first five pages count (the cap is the feature)."""
    p = documents(spark, d).select((F.col("doc_id") / 10).cast("long").alias("book"), (F.col("doc_id") % 10 + 1).alias("page_no"), "n_chars")
    return pages.first_pages(p, 5).groupBy("book").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("n_chars"))


LINES = {
    "page_metadata": (page_metadata, f"SELECT doc_id, count(*) AS pages, count(CASE WHEN {nonspace('coalesce(text, chr(32))')} > 0 THEN 1 END) AS text_pages FROM documents GROUP BY doc_id"),
    "nonblank_lines": (nonblank_lines, sql(f"SELECT doc_id, line_no, text FROM v_lines WHERE {nonspace('text')} > 0")),
    "junk_filter": (junk_filter, sql(f"SELECT doc_id, line_no, conf FROM v_lines WHERE {KEEP}")),
    "junk_counts": (junk_counts, sql(f"SELECT doc_id, page_no, count(CASE WHEN {KEEP} THEN 1 END) AS kept, count(CASE WHEN NOT {KEEP} THEN 1 END) AS dropped FROM v_lines GROUP BY ALL")),
    "page_writing_mode": (page_writing_mode, sql("SELECT * FROM v_modes", TALL, MODES)),
    "document_writing_mode": (document_writing_mode, sql("SELECT doc_id // 10 AS doc_id, CASE WHEN count_if(writing_mode = 'Vertical') * 2 > count(*) THEN 'Vertical' ELSE 'Horizontal' END AS writing_mode FROM v_modes GROUP BY doc_id // 10", TALL, MODES)),
    "document_language": (document_language, _language("documents")),
    "script_language": (script_language, _language("(VALUES " + ", ".join(f"({i}::BIGINT, '{x}')" for i, x in CJK_ROWS) + ") AS v(doc_id, text)")),
    "layer_quality": (layer_quality, sql("SELECT * FROM v_quality", QUALITY)),
    "pages_needing_ocr": (need_ocr, sql("SELECT doc_id, page_no FROM v_quality WHERE NOT usable", QUALITY)),
    "body_statistics": (body_statistics, sql("SELECT * FROM v_stats", STATS.format("v_lines"))),
    "gutter_search": (gutter_search, sql(GUTTERS)),
    "reading_order": (reading_order, sql("SELECT doc_id, page_no, line_no, column_no, reading_order FROM v_order", f"v_shown AS (SELECT * FROM v_lines WHERE {nonspace('text')} > 0)", ordered("v_shown", "v_order", "line_no"))),
    "first_pages": (first_pages, "SELECT doc_id // 10 AS book, count(*) AS pages, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id % 10 + 1 <= 5 GROUP BY 1"),
}
