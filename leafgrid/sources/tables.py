"""Lines and regions derived from plain documents, for running the layout operators on any corpus of texts.

A document is one page; its lines are laid out in one or two columns by integer arithmetic on their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, x, y, w, h, text, conf, source, ink)."""
    one = F.col("doc_id") % 3 == 0
    n, d = F.col("line_no"), F.col("doc_id")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select(
        "doc_id", F.col("doc_id").cast("int").alias("page_no"), "line_no",
        (F.when(one | (n % 2 == 0), 50).otherwise(550) / 1000.0).alias("x"),
        ((40 + n * 23 % 900) / 1000.0).alias("y"),
        (F.when(one, 800).otherwise(400) / 1000.0).alias("w"),
        ((15 + F.when(n % 11 == 0, 15).when(n % 7 == 0, 6).otherwise(0)) / 1000.0).alias("h"),
        "text",
        ((55 + (d * 31 + n * 17) % 45) / 100.0).alias("conf"),
        F.when(d % 4 == 1, "PdfTextLayer").otherwise("Ocr").alias("source"),
        F.when(n % 5 != 4, (10 + (d * 7 + n * 13) % 30) / 100.0).alias("ink"),
    )


def regions_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_no, x, y, w, h, kind): a figure or a box on some pages."""
    fig = F.col("doc_id") % 5 == 0
    pick = lambda a, b: F.when(fig, a).otherwise(b)
    return docs.filter(F.col("doc_id") % 5 < 2).select(
        "doc_id", F.col("doc_id").cast("int").alias("page_no"), F.lit(1).alias("region_no"), pick(0.05, 0.55).alias("x"), pick(0.30, 0.50).alias("y"), F.lit(0.40).alias("w"), pick(0.20, 0.15).alias("h"), pick("Figure", "Boxed").alias("kind")
    )


#: The same in DuckDB's SQL.
SQL_VIEWS = """
v_lines AS (SELECT doc_id, doc_id::INT AS page_no, (i - 1)::INT AS line_no, (CASE WHEN doc_id % 3 = 0 OR (i - 1) % 2 = 0 THEN 50 ELSE 550 END) / 1000.0::DOUBLE AS x,
 (40 + (i - 1) * 23 % 900) / 1000.0::DOUBLE AS y, (CASE WHEN doc_id % 3 = 0 THEN 800 ELSE 400 END) / 1000.0::DOUBLE AS w,
 (15 + CASE WHEN (i - 1) % 11 = 0 THEN 15 WHEN (i - 1) % 7 = 0 THEN 6 ELSE 0 END) / 1000.0::DOUBLE AS h, l AS text,
 (55 + (doc_id * 31 + (i - 1) * 17) % 45) / 100.0::DOUBLE AS conf, CASE WHEN doc_id % 4 = 1 THEN 'PdfTextLayer' ELSE 'Ocr' END AS source,
 CASE WHEN (i - 1) % 5 <> 4 THEN (10 + (doc_id * 7 + (i - 1) * 13) % 30) / 100.0::DOUBLE END AS ink
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
v_regions AS (SELECT doc_id, doc_id::INT AS page_no, 1 AS region_no, CASE WHEN doc_id % 5 = 0 THEN 0.05::DOUBLE ELSE 0.55::DOUBLE END AS x, CASE WHEN doc_id % 5 = 0 THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END AS y,
 0.40::DOUBLE AS w, CASE WHEN doc_id % 5 = 0 THEN 0.20::DOUBLE ELSE 0.15::DOUBLE END AS h, CASE WHEN doc_id % 5 = 0 THEN 'Figure' ELSE 'Boxed' END AS kind FROM documents WHERE doc_id % 5 < 2)
"""
