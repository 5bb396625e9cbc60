"""Edges of the engine: files decoded by a function that the caller plugs in.

A decoder takes (path, bytes) and yields rows; it runs on the executors. A file that it cannot read becomes one error row,
never a failed job. Filter the files before they come here: Spark may evaluate a Python stage for rows that a later filter drops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS = "doc_id long, page_no int, char_no int, ch string, left double, top double, right double, bottom double, size double"
#: Decoded rows that go back to the JVM together.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 5_000
PAGES = "doc_id long, page_no int, width int, height int, raw_text string"


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content, length, modified)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content", "length", F.col("modificationTime").alias("modified"))


def decode(inputs: DataFrame, decoder: Callable[[str, bytes], Iterable[tuple]], schema: str, max_pages: int | None = None, key: str = "path string") -> DataFrame:
    """Rows of the decoder with path and error. max_pages is handed to a decoder that takes it as third argument."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        """Columns with gaps stay objects, or large whole numbers would become floats beside them."""
        columns = {c: pd.Series(v, dtype=object) for c, v in zip([*names, "path", "error"], zip(*rows))}
        return pd.DataFrame({c: v if v.isna().any() else v.infer_objects() for c, v in columns.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, held = [], 0
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows = [(*r, path, None) for r in (decoder(path, bytes(content)) if max_pages is None else decoder(path, bytes(content), max_pages))]
                    if any(len(r) != len(names) + 2 for r in rows):
                        raise ValueError(f"a row of {len(rows[0]) - 2} values for {len(names)} columns")
                except Exception as e:  # the row says what happened
                    rows = [(*[None] * len(names), path, f"{type(e).__name__}: {e}")]
                out += rows
                held += sum(len(v) if isinstance(v, (bytes, str)) else 8 for r in rows for v in r)
                if held > BATCH_BYTES or len(out) > BATCH_ROWS:  # small files share a frame, large ones don't
                    yield framed(out)
                    out, held = [], 0
            if out:
                yield framed(out)

    return inputs.select("path", "content").mapInPandas(run, f"{schema}, {key}, error string")


def decoded_images(found: DataFrame, decoder: Callable[[bytes], object], on_empty: str = "skip") -> DataFrame:
    """(doc_id, page_no, width, height, pixels, error) of images (doc_id, page_no, content): pixels are rows of blue, green and red bytes.

    The decoder yields an array of height x width x 3, or nothing for an image that it can't read: such a row is left out ("skip") or says so ("error").
    """
    if on_empty not in ("skip", "error"):
        raise ValueError(f"unknown rule for empty images {on_empty}")
    out = decode(found.selectExpr("struct(doc_id, page_no) AS path", "content"), lambda _, content: [(a.shape[1], a.shape[0], a.tobytes())] if (a := decoder(content)) is not None and a.size else [(None, None, None)], "width int, height int, pixels binary", key="path struct<doc_id: long, page_no: int>")
    out = out.select("path.*", "width", "height", "pixels", F.when(F.col("error").isNull() & F.col("pixels").isNull(), "empty image").otherwise(F.col("error")).alias("error"))
    return out if on_empty == "error" else out.filter("pixels is not null")


def detector_side(width: Column, height: Column, preset: int = 960, most: int = 4096) -> Column:
    """The longer side that a detector works at: the image's own, but neither below its preset nor above the most."""
    return F.least(F.lit(most), F.greatest(F.lit(preset), width, height))


def upside_down(found: DataFrame) -> DataFrame:
    """(doc_id, page_no, turned): whether most lines of a page say so. found: (doc_id, page_no, turned)."""
    return found.groupBy("doc_id", "page_no").agg((F.count_if("turned") * 2 > F.count("turned")).alias("turned"))


def recognise(images: DataFrame, recogniser: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Lines by a recogniser that yields (polygon [(x, y), ...] in pixels, text, character scores, image width, image height).

    Boxes are the polygons' extent in page ratios, nothing of a page without size; the confidence is the mean score, 0 for none; blank texts are dropped.
    """
    schema = "doc_id long, page_no int, line_no int, xs array<double>, ys array<double>, text string, scores array<double>, width double, height double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                rows = [(r.doc_id, r.page_no, k, [float(p[0]) for p in poly], [float(p[1]) for p in poly], text, [float(s) for s in scores], float(w), float(h)) for k, (poly, text, scores, w, h) in enumerate(recogniser(bytes(r.content)))]
                yield pd.DataFrame(rows, columns=["doc_id", "page_no", "line_no", "xs", "ys", "text", "scores", "width", "height"])

    found = images.select("doc_id", "page_no", "content").mapInPandas(run, schema)
    mean = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / F.size("scores")).otherwise(0.0)
    x, y = F.array_min("xs"), F.array_min("ys")
    ratio = lambda v, side: F.coalesce(F.try_divide(v, F.col(side)), F.lit(0.0))
    from ..functions.text import is_blank

    return found.filter(~is_blank(F.col("text"))).select(
        "doc_id", "page_no", "line_no", ratio(x, "width").alias("x"), ratio(y, "height").alias("y"), ratio(F.array_max("xs") - x, "width").alias("w"), ratio(F.array_max("ys") - y, "height").alias("h"),
        "text", mean.alias("conf"), F.lit("Ocr").alias("source"), F.lit(None).cast("double").alias("ink"),
    )


def ask(prompts: DataFrame, model: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """Answers of a language model to prompts (doc_id, page_no, chunk_no, prompt): (…, json, error). Errors and answers that are no JSON are tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for f in frames:
            answers, errors = [], []
            for prompt in f["prompt"]:
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = model(prompt), None
                        json.loads(answer)
                        break
                    except Exception as e:
                        answer, error = None, f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield f[["doc_id", "page_no", "chunk_no"]].assign(json=answers, error=errors)

    return prompts.mapInPandas(run, "doc_id long, page_no int, chunk_no int, json string, error string")


def chunk_status(answers: DataFrame) -> DataFrame:
    """Per page: error if all its requests failed, partial if some did, else ok."""
    bad = F.count_if(F.col("json").isNull())
    return answers.groupBy("doc_id", "page_no").agg(F.when(bad == F.count("*"), "error").when(bad > 0, "partial").otherwise("ok").alias("status"))
