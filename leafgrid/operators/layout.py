"""Rule layout of a page: regions against lines, body statistics, block types, captions, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

PAGE = ["doc_id", "page_no"]


def _regions(regions: DataFrame, kind: str | None = None) -> DataFrame:
    r = regions if kind is None else regions.filter(F.col("kind") == kind)
    return r.select(*PAGE, "region_no", *[F.col(c).alias(f"r{c}") for c in "xywh"], F.col("kind").alias("region_kind"))


def contained(lines: DataFrame, regions: DataFrame, kind: str | None = None, how: str = "inner", share: float = 0.5) -> DataFrame:
    """Lines joined (inner, left_semi or left_anti) with the regions that hold more than that share of them. The page is the equi key."""
    r = _regions(regions, kind)
    on = [lines[c] == r[c] for c in PAGE] + [g.share_of(g.box(), g.box("r")) > share]
    out = lines.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.select(*[lines[c] for c in lines.columns], *[r[c] for c in r.columns if c not in PAGE])


def free_boxes(regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Figures, and boxes that share no more than that part of the smaller area with a figure."""
    fig = _regions(regions, "Figure")
    boxed = regions.filter("kind = 'Boxed'")
    free = boxed.join(fig, [boxed[c] == fig[c] for c in PAGE] + [g.share_of_smaller(g.box(), g.box("r")) > share], "left_anti")
    return regions.filter("kind = 'Figure'").unionByName(free)


def code_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Figure regions that hold code, as blocks: text lines in (y, x) order, the lowest confidence, the first line's source."""
    held = contained(lines, regions, "Figure")
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "line_no", "text", "source")))
    groups = held.groupBy(*PAGE, "region_no", "rx", "ry", "rw", "rh").agg(
        F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"), F.sum(t.count_of(text, t.CODE_SYMBOLS)).alias("symbols"), F.sum(t.nonspace(text)).alias("chars"), ordered.alias("lines"), F.min("conf").alias("conf")
    )
    is_code = (F.col("n") >= 2) & (F.col("rw") * F.col("rh") > 0) & (F.col("area") / (F.col("rw") * F.col("rh")) >= 0.25) & (F.col("chars") > 0) & (F.col("symbols") / F.col("chars") >= 0.05)
    return groups.filter(is_code).select(*PAGE, "region_no", *[F.col(f"r{c}").alias(c) for c in "xywh"], F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("text"), "conf", F.col("lines")[0]["source"].alias("source"))


def body_stats(lines: DataFrame) -> DataFrame:
    """Per page, the upper medians of line height and of ink (null below five measured lines)."""
    ink = F.when(F.count("ink") >= 5, g.upper_median("ink"))
    return lines.groupBy(*PAGE).agg(g.upper_median("h").alias("body_h"), ink.alias("body_ink"))


def with_body_stats(lines: DataFrame, height: str = "h") -> DataFrame:
    """lines with their page's statistics, over one shuffle and without a join. Rows whose height is null don't count."""
    page = "OVER (PARTITION BY doc_id, page_no)"
    med = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC) " + page
    return lines.withColumn("body_h", F.expr(med.format(height))).withColumn("body_ink", F.expr(f"CASE WHEN count(ink) {page} >= 5 THEN {med.format('ink')} END"))


def with_page_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines, and the regions as lines of no text whose kind isn't null, with _regions: the few regions of their page as an array. One shuffle by page serves
    this, the page's statistics and its order (y, x, line_no)."""
    columns = [*PAGE, "line_no", *"xywh", "text", "conf", "source", "ink"]
    kinds = dict(lines.dtypes)
    given = {"line_no": F.lit(-1), "text": F.lit(""), "conf": F.lit(1.0), "source": F.lit("Unknown"), "ink": F.lit(None)}
    flat = regions.select(*[given.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in columns], F.col("kind"), F.lit(True).alias("_region"))
    both = lines.select(*columns, F.lit(None).cast("string").alias("kind"), F.lit(False).alias("_region")).unionByName(flat)
    mine = F.when(F.col("_region"), F.struct("kind", *"xywh"))
    sorted_ = both.repartition(*PAGE).sortWithinPartitions(*PAGE, "y", "x", "line_no")
    return sorted_.withColumn("_regions", F.collect_list(mine).over(Window.partitionBy(*PAGE)))


def held_by(kind: str, share: float = 0.5) -> Column:
    """Whether a region of that kind in _regions holds more than that share of the line."""
    return F.coalesce(F.exists("_regions", lambda r: (r["kind"] == kind) & (g.share_of(g.box(), tuple(r[c] for c in "xywh")) > share)), F.lit(False))


def block_type() -> Column:
    """The type of a line, from columns y, h, text, ink, body_h and body_ink."""
    text, y, h = F.coalesce(F.col("text"), F.lit("")), F.col("y"), F.col("h")
    short = F.length(text) <= 30
    ratio = F.when(F.col("body_h") > 0, h / F.col("body_h")).otherwise(1.0)
    core = F.regexp_replace(text, t.WS, "")
    title = (y < 0.4) & (F.length(core) >= 3) & core.rlike(r"^[\p{L}\p{Nd}]") & ~core.rlike(r"^[\p{Nd}]*$")
    bold = short & (F.length(core) >= 4) & F.col("ink").isNotNull() & F.col("body_ink").isNotNull() & (F.col("ink") >= 1.4 * F.col("body_ink")) & (F.col("ink") < 3 * F.col("body_ink"))
    return (
        F.when((y + h > 0.94) & short & text.rlike(r"^\p{Nd}*\z"), "PageNumber").when((y < 0.06) & short, "Header").when((y + h > 0.94) & short, "Footer")
        .when((ratio >= 1.8) & title, "ChapterTitle").when(ratio >= 1.8, "Decorative").when(ratio >= 1.35, "SectionHeading").when(ratio >= 1.15, "Subheading").when(bold, "Subheading").otherwise("Body")
    )


def classify(lines: DataFrame, regions: DataFrame, figures: bool = False) -> DataFrame:
    """Lines outside figures with type, heading_level, is_excluded and requires_review; those inside boxes are asides. With figures, these are rows too, of line_no -1."""
    page = with_page_regions(lines, regions)
    shown = ~F.col("_region") & ~held_by("Figure")
    free = page.filter(shown | (F.col("_region") & (F.col("kind") == "Figure")) if figures else shown)
    typed = with_body_stats(free.withColumn("boxed", held_by("Boxed")).withColumn("line_h", F.when(~F.col("_region"), F.col("h"))).drop("_regions"), "line_h")
    kind = F.when(F.col("_region"), "Figure").when(F.col("boxed"), "Aside").otherwise(block_type())
    return typed.withColumn("type", kind).select(
        *PAGE, "line_no", *"xywh", "text", "conf", "source", "type", t.heading_level(F.col("type")).alias("heading_level"), F.col("type").isin("Header", "Footer", "PageNumber").alias("is_excluded"), (F.col("conf") < 0.85).alias("requires_review")
    )


def fixed_blocks(lines: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Each line a Body block, in rows from the top; pages in vertical writing are ordered by transposed boxes. No columns are sought here."""
    lines = lines.filter(~t.is_blank(F.col("text")))
    if modes is not None:
        lines = lines.join(modes.select(*PAGE, "writing_mode"), PAGE, "left")
    vertical = F.coalesce(F.col("writing_mode") == "Vertical", F.lit(False)) if modes is not None else F.lit(False)
    tx, ty = (F.when(vertical, a).otherwise(b) for a, b in zip(g.transposed(g.box())[:2], g.box()[:2]))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy(ty, tx, "line_no")) - 1
    return lines.withColumn("reading_order", order).select(
        *PAGE, block_id(F.col("page_no"), F.col("reading_order") + 1).alias("block_id"), *"xywh", F.lit("Body").alias("type"), F.col("text").alias("ocr_text"), "conf", "source", "reading_order", (F.col("conf") < 0.85).alias("requires_review")
    )


def block_id(page: Column, index: Column) -> Column:
    return F.format_string("p%04d-b%04d", page, index)


def captions(blocks: DataFrame) -> DataFrame:
    """blocks with related_block_id: up to three Body blocks right after a figure, each close below the one before and beside it, become its captions."""
    w = Window.partitionBy(*PAGE).orderBy("reading_order")
    prev = lambda c, k: F.lag(c, k).over(w)

    def follows(k: int) -> Column:
        """The k-th row back continues the chain to the next one."""
        top, left, right = (F.col("y"), F.col("x"), F.col("x") + F.col("w")) if k == 1 else (prev("y", k - 1), prev("x", k - 1), prev("x", k - 1) + prev("w", k - 1))
        gap = top - (prev("y", k) + prev("h", k))
        return (gap >= 0) & (gap <= 0.03)

    def beside(k: int) -> Column:
        """Rows 0 .. k - 1 lie beside the figure k rows back."""
        out = F.lit(True)
        for j in range(k):
            x, width = (F.col("x"), F.col("w")) if j == 0 else (prev("x", j), prev("w", j))
            out &= F.least(x + width, prev("x", k) + prev("w", k)) - F.greatest(x, prev("x", k)) > 0
        return out

    body = F.col("type") == "Body"
    owner = F.lit(None).cast("string")
    for k in (3, 2, 1):
        chain = body & (prev("type", k) == "Figure") & beside(k)
        for j in range(1, k + 1):
            chain &= follows(j)
            if j < k:
                chain &= prev("type", j) == "Body"
        owner = F.when(chain, prev("block_id", k)).otherwise(owner)
    return blocks.withColumn("related_block_id", owner).withColumn("type", F.when(F.col("related_block_id").isNotNull(), "Caption").otherwise(F.col("type")))
