"""Image operators on numpy arrays, and the rules about image files as columns.

Pixels come from a decoder that the caller plugs in (see sources.decoders); everything here works on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

COLOURS = dict(zip(t.BLOCK_TYPES, "#757575 #d32f2f #f57c00 #fbc02d #1976d2 #388e3c #00796b #7b1fa2 #c2185b #5d4037 #455a64 #90a4ae #78909c #607d8b #bdbdbd #303f9f".split()))


def flatten(rgba: np.ndarray) -> np.ndarray:
    """On white."""
    a = rgba[..., 3:].astype(np.float64) / 255
    return np.rint(rgba[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def grey(bgr: np.ndarray) -> np.ndarray:
    return bgr if bgr.ndim == 2 else np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold of greatest variance between the two classes."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def ink_density(image: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> list[float]:
    """Share of black pixels in each box (ratios), after one threshold for the page; boxes are cut to the image."""
    black = (grey(image) <= otsu(grey(image))).astype(np.int64)
    total = np.pad(black.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    high, wide = black.shape
    out = []
    for x, y, w, h in boxes:
        left, top = min(max(0, int(x * wide)), wide - 1), min(max(0, int(y * high)), high - 1)
        right, bottom = min(wide, left + max(1, int(w * wide))), min(high, top + max(1, int(h * high)))
        out.append(float(total[bottom, right] - total[top, right] - total[bottom, left] + total[top, left]) / ((right - left) * (bottom - top)))
    return out


def paper_stats(bgr: np.ndarray) -> tuple[float, float, float, float, float]:
    """(luminance that 95 % of pixels don't exceed, share of pixels near it, their mean blue, green and red)."""
    luma = grey(bgr)
    n = np.bincount(luma.ravel(), minlength=256)
    level = int(np.argmax(np.cumsum(n) / n.sum() >= 0.95))
    mask = luma > level - 16
    return (float(level), float(mask.mean()), *(float(bgr[..., c][mask].mean()) for c in range(3)))


def enhance(bgr: np.ndarray, paper: tuple[float, float, float] | None) -> np.ndarray:
    """Paper made white: balance per channel (at most 1.4), then a smooth step to 255 for bright, pale pixels near the paper's tint."""
    if paper is None:
        return bgr
    scale = np.clip(255 / np.maximum(np.array(paper, float), 1), 1, 1.4)
    x = np.minimum(bgr * scale, 255)
    luma = x @ np.array([0.114, 0.587, 0.299])
    spread = x.max(-1) - x.min(-1)
    saturation = np.where(x.max(-1) > 0, spread / np.maximum(x.max(-1), 1e-9) * 255, 0)
    w = np.clip((luma - 222) / 25, 0, 1)
    w = w * w * (3 - 2 * w) * ((saturation <= 55) & (spread <= 24))
    return np.rint(x + (255 - x) * w[..., None]).astype(np.uint8)


def rotated(image: np.ndarray, angle: float, fill: int = 255) -> np.ndarray:
    """Nearest neighbour, about the centre, same size."""
    high, wide = image.shape[:2]
    a = np.deg2rad(angle)
    y, x = np.mgrid[:high, :wide]
    dx, dy = x - (wide - 1) / 2, y - (high - 1) / 2
    sx, sy = np.rint(dx * np.cos(a) - dy * np.sin(a) + (wide - 1) / 2).astype(int), np.rint(dx * np.sin(a) + dy * np.cos(a) + (high - 1) / 2).astype(int)
    ok = (sx >= 0) & (sx < wide) & (sy >= 0) & (sy < high)
    out = np.full_like(image, fill)
    out[ok] = image[sy[ok], sx[ok]]
    return out


def skew(image: np.ndarray, limit: float = 10.0) -> float | None:
    """The angle by which to turn the page so that text rows lie level, or None: blank pages, angles under 0.2 degrees and gains under 1.3.

    The score of an angle is the spread of row sums after turning; coarse steps of half a degree, then fine ones of a tenth.
    """
    luma = grey(image)
    step = max(1, round(luma.shape[0] / 800))
    luma = luma[::step, ::step]
    ink = (luma <= otsu(luma)).astype(np.uint8)
    if ink.mean() < 0.001 or ink.all():
        return None
    ys, xs = np.nonzero(ink)
    dx, dy = xs - (ink.shape[1] - 1) / 2, ys - (ink.shape[0] - 1) / 2

    def score(angle: float) -> float:
        a = np.deg2rad(angle)
        row = np.rint(dx * np.sin(-a) + dy * np.cos(a) + (ink.shape[0] - 1) / 2).astype(int)
        return float(np.bincount(np.clip(row, 0, ink.shape[0] - 1), minlength=ink.shape[0]).std())

    coarse = max(np.arange(-limit, limit + 1e-9, 0.5), key=score)  # the first of equals
    fine = max(np.clip(coarse + np.arange(-0.5, 0.5 + 1e-9, 0.1), -limit, limit), key=score)
    if abs(fine) < 0.2 or score(fine) < 1.3 * score(0.0):
        return None
    return round(float(fine), 3)


def edges(luma: np.ndarray, low: float = 60, high: float = 160) -> np.ndarray:
    """Steep places: Sobel gradients beyond the upper threshold, and those beyond the lower one that hang together with such."""
    p = np.pad(luma.astype(np.int32), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    steep = np.abs(gx) + np.abs(gy)
    label = labelled(steep > low)
    return np.isin(label, np.unique(label[steep > high])) & (label > 0)


def labelled(mask: np.ndarray) -> np.ndarray:
    """A number for each connected area (neighbours by side), 0 outside: the largest place in it, which spreads along rows and columns."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label
        for axis in (0, 1):
            for flip in (False, True):
                v = np.flip(new, axis) if flip else new
                run = _spread(v, axis)
                new = np.flip(run, axis) if flip else run
        if (new == label).all():
            return label
        label = new


def frame_boxes(image: np.ndarray, least: float = 0.02, most: float = 0.7, fill: float = 0.9, hole: float = 0.6) -> list[tuple[float, float, float, float]]:
    """Thin rectangles of ink around a large hollow, of a box's size: with what they enclose they fill their extent, and the largest hollow most of that."""
    luma = grey(image)
    ink = luma <= otsu(luma)
    high, wide = ink.shape
    ground = labelled(~ink)
    border = np.unique(np.concatenate([ground[0], ground[-1], ground[:, 0], ground[:, -1]]))
    ink_label = labelled(ink)
    out = []
    for k in np.unique(ink_label[ink_label > 0]):
        ys, xs = np.nonzero(ink_label == k)
        top, left, h, w = ys.min(), xs.min(), int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
        if not least <= h * w / (high * wide) <= most:
            continue
        inside = ground[top : top + h, left : left + w]
        holes = {int(g): int((inside == g).sum()) for g in np.unique(inside[inside > 0]) if g not in border}
        own = int((ink_label[top : top + h, left : left + w] == k).sum())
        if holes and own + sum(holes.values()) >= fill * h * w and max(holes.values()) >= hole * (own + sum(holes.values())):
            out.append((float(left / wide), float(top / high), float(w / wide), float(h / high)))
    return sorted(out, key=lambda b: (b[1], b[0]))


def figure_boxes(image: np.ndarray, text: list[tuple[float, float, float, float]], least: float = 0.015, most: float = 0.6, margin: float = 0.04) -> list[tuple[float, float, float, float]]:
    """Connected areas of edges outside text and the page's margin, joined over 25 pixels, of a figure's size and shape."""
    edge = edges(grey(image))
    high, wide = edge.shape
    my, mx = int(high * margin), int(wide * margin)
    inner = np.zeros_like(edge)
    inner[my : high - my, mx : wide - mx] = True
    edge &= inner
    for x, y, w, h in text:
        m = 0.04 * h
        edge[max(0, int((y - m) * high)) : int((y + h + m) * high) + 1, max(0, int(x * wide)) : int((x + w) * wide) + 1] = False
    for axis in (0, 1):  # dilation by a box
        total = np.cumsum(np.pad(edge.astype(np.int32), [(13, 12) if a == axis else (0, 0) for a in (0, 1)]), axis)
        edge = np.take(total, np.arange(24, 24 + edge.shape[axis]), axis) - np.pad(total, [(1, 0) if a == axis else (0, 0) for a in (0, 1)]).take(np.arange(edge.shape[axis]), axis) > 0
    label = labelled(edge)
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        x, y, w, h = xs.min() / wide, ys.min() / high, (np.ptp(xs) + 1) / wide, (np.ptp(ys) + 1) / high
        if least <= w * h <= most and 0.125 <= (w * wide) / (h * high) <= 8:
            out.append((float(x), float(y), float(w), float(h)))
    return sorted(out, key=lambda b: (b[1], b[0]))


def _spread(v: np.ndarray, axis: int) -> np.ndarray:
    """Running maximum along the axis within runs of non-zero cells."""
    v = v if axis == 1 else v.T
    run = np.cumsum(v == 0, 1)
    big = run.astype(np.int64) * (int(v.max()) + 1) + v
    out = np.where(v > 0, np.maximum.accumulate(big, 1) - run.astype(np.int64) * (int(v.max()) + 1), 0)
    return out if axis == 1 else out.T


IMAGE = ["doc_id", "page_no", "width", "height", "pixels"]


def _each_image(images: DataFrame, work: Callable, schema: str, *more: str) -> DataFrame:
    """work(array, further columns' values) gives rows for each image; (doc_id, page_no) and the rows' columns come back. A page is the unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            columns = [b.column(k) for k in range(b.num_columns)]
            for k in range(b.num_rows):
                width, height, pixels, *rest = (c[k].as_py() for c in columns[2:])
                made = work(np.frombuffer(pixels, np.uint8).reshape(height, width, 3), *rest)
                place += [k] * len(made)
                rows += made
            at = pa.array(place, pa.int64())
            made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays([columns[0].take(at), columns[1].take(at), *made], ["doc_id", "page_no", *(f.name for f in target)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    target = list(to_arrow_schema(kind))
    keys = StructType([images.schema["doc_id"], images.schema["page_no"]])
    return images.filter("pixels is not null").select(*IMAGE, *more).mapInArrow(run, StructType(keys.fields + kind.fields))


def page_paper_stats(images: DataFrame) -> DataFrame:
    """(doc_id, page_no, luminance, share, b, g, r) of each image (doc_id, page_no, width, height, pixels)."""
    return _each_image(images, lambda a: [paper_stats(a)], "luminance double, share double, b double, g double, r double")


def page_skew(images: DataFrame) -> DataFrame:
    """(doc_id, page_no, angle), null where a page is taken as it is."""
    return _each_image(images, lambda a: [(skew(a),)], "angle double")


def enhanced(images: DataFrame, profile: DataFrame) -> DataFrame:
    """The images with the paper of their document (doc_id, b, g, r) made white; those of documents without a profile stay."""
    j = images.join(profile.select("doc_id", F.array("b", "g", "r").alias("paper")), "doc_id", "left")
    return _each_image(j, lambda a, paper: [(a.shape[1], a.shape[0], enhance(a, paper and tuple(paper)).tobytes())], "width int, height int, pixels binary", "paper")


def straightened(images: DataFrame) -> DataFrame:
    """The images turned level, with the angle (0 where they were)."""

    def turn(a: np.ndarray) -> list[tuple]:
        angle = skew(a)
        return [(a.shape[1], a.shape[0], (a if angle is None else rotated(a, angle)).tobytes(), angle or 0.0)]

    return _each_image(images, turn, "width int, height int, pixels binary, angle double")


def _with_boxes(images: DataFrame, lines: DataFrame) -> DataFrame:
    boxes = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", *[F.col(c).cast("double").alias(c) for c in "xywh"]))).alias("boxes"))
    return images.join(boxes, ["doc_id", "page_no"], "left")


def line_ink(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, ink) of the lines whose page has an image."""

    def measure(a: np.ndarray, boxes: list[dict] | None) -> list[tuple]:
        boxes = boxes or []
        return [(b["line_no"], d) for b, d in zip(boxes, ink_density(a, [tuple(b[c] for c in "xywh") for b in boxes]))]

    return _each_image(_with_boxes(images, lines), measure, "line_no int, ink double", "boxes")


def page_regions(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_no, x, y, w, h, kind): figures, and frames that no figure covers (see layout.free_boxes for tables of them)."""
    share = lambda p, q: max(0.0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])) * max(0.0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])) / max(min(p[2] * p[3], q[2] * q[3]), 1e-12)

    def find(a: np.ndarray, boxes: list[dict] | None) -> list[tuple]:
        figures = figure_boxes(a, [tuple(b[c] for c in "xywh") for b in boxes or []])
        frames = [f for f in frame_boxes(a) if not any(share(f, g) > 0.5 for g in figures)]
        return [(k, *box, kind) for k, (box, kind) in enumerate([(b, "Figure") for b in figures] + [(b, "Boxed") for b in frames], 1)]

    return _each_image(_with_boxes(images, lines), find, "region_no int, x double, y double, w double, h double, kind string", "boxes")


def transcode_rule(images: DataFrame, longest: int | None = 2200, png_limit: int = 200 * 1024) -> DataFrame:
    """images (path, width, height, bytes) with media_type, transcode, target_width, target_height; an unknown extension is an error row."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    too_long = (F.greatest("width", "height") > longest) if longest and longest > 0 else F.lit(False)
    needs = too_long | ((ext == "png") & (F.col("bytes") > png_limit))
    w, h = g.target_size(F.col("width"), F.col("height"), longest)
    known = ext.isin("png", "jpg", "jpeg", "webp")
    return images.select(
        "path", F.when(needs & known, "image/jpeg").when(known, t.media_type(F.col("path"))).alias("media_type"), (needs & known).alias("transcode"), F.when(needs, w).otherwise(F.col("width")).alias("target_width"),
        F.when(needs, h).otherwise(F.col("height")).alias("target_height"), F.when(~known, "unknown extension").alias("error"),
    )


def transcoded(contents: DataFrame, rules: DataFrame, encoder: Callable[[bytes, int, int, int], bytes] | None, quality: int = 85) -> DataFrame:
    """(path, content): images (path, content) as their rule says, by an encoder of (content, width, height, quality); without one all stay as they are."""
    if encoder is None:
        return contents.select("path", "content")
    quality = min(100, max(1, quality))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encoder(c, w, h, quality) if t else c for c, t, w, h in zip(*(b.column(k).to_pylist() for k in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["path", "content"])

    j = contents.join(rules.filter("error is null"), "path").select("path", "content", "transcode", "target_width", "target_height")
    return j.mapInArrow(run, "path string, content binary")


def figure_images(images: DataFrame, blocks: DataFrame, encoder: Callable[[np.ndarray, int], bytes], quality: int = 90) -> DataFrame:
    """(doc_id, page_no, block_id, content): each figure cut out of its page's image, by an encoder of (pixels, quality)."""
    figures = blocks.filter("type = 'Figure'").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("block_id", *[F.col(c).cast("double").alias(c) for c in "xywh"]))).alias("figures"))
    cut = lambda a, found: [(f["block_id"], encoder(crop(a, tuple(f[c] for c in "xywh")), quality)) for f in found]
    return _each_image(images.join(figures, ["doc_id", "page_no"]), cut, "block_id string, content binary", "figures")


def overlays(images: DataFrame, blocks: DataFrame, most: int = 1200) -> DataFrame:
    """The images, no wider than that, with their blocks' frames drawn: in the colour of the type, thin where a block is excluded."""
    kinds = F.array_sort(F.collect_list(F.struct("reading_order", "type", "is_excluded", *[F.col(c).cast("double").alias(c) for c in "xywh"])))
    drawn = blocks.groupBy("doc_id", "page_no").agg(kinds.alias("blocks"))

    def draw(a: np.ndarray, found: list[dict] | None) -> list[tuple]:
        wide = min(most, a.shape[1])
        high = max(1, round(a.shape[0] * wide / a.shape[1]))
        out = a[np.arange(high) * a.shape[0] // high][:, np.arange(wide) * a.shape[1] // wide].copy()
        for b in found or []:
            x, y = min(max(0, int(b["x"] * wide)), wide - 1), min(max(0, int(b["y"] * high)), high - 1)
            w, h, t = min(max(1, int(b["w"] * wide)), wide - x), min(max(1, int(b["h"] * high)), high - y), 1 if b["is_excluded"] else 3
            c = COLOURS.get(b["type"], "#757575")
            shade = [int(c[k : k + 2], 16) for k in (5, 3, 1)]  # blue, green, red
            for part in (out[y : y + min(t, h), x : x + w], out[y + h - min(t, h) : y + h, x : x + w], out[y : y + h, x : x + min(t, w)], out[y : y + h, x + w - min(t, w) : x + w]):
                part[:] = shade
        return [(wide, high, out.tobytes())]

    return _each_image(images.join(drawn, ["doc_id", "page_no"], "left"), draw, "width int, height int, pixels binary", "blocks")


def colour(kind: Column) -> Column:
    """The overlay colour of a type."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), kind), F.lit("#757575"))


def channels(hex_colour: Column) -> Column:
    part = lambda k: F.conv(F.substring(hex_colour, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def overlay_boxes(blocks: DataFrame, width: int = 1200, height: int = 1600) -> DataFrame:
    """(doc_id, page_no, block_id, left, top, wide, high, r, g, b, thickness, label) for drawing blocks over a page image of that size."""
    x, y, w, h = g.pixels(g.box(), F.lit(width), F.lit(height))
    c = channels(colour(F.col("type")))
    label = F.concat(F.col("reading_order").cast("string"), F.lit(" "), F.col("type"))
    return blocks.select("doc_id", "page_no", "block_id", x.alias("left"), y.alias("top"), w.alias("wide"), h.alias("high"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.when(F.col("is_excluded"), 1).otherwise(3).alias("thickness"), label.alias("label"))


def figure_gate(candidates: DataFrame) -> DataFrame:
    """Candidate rectangles (…, w, h as ratios, image_width, image_height) of a figure's size and shape."""
    aspect = F.col("w") * F.col("image_width") / (F.col("h") * F.col("image_height"))
    return candidates.filter((F.col("w") * F.col("h")).between(0.015, 0.6) & aspect.between(0.125, 8.0))


def boxed_gate(contours: DataFrame) -> DataFrame:
    """Contours (…, w, h, vertices, hole_area, outer_area) that are frames: four corners, one large hole, of a box's size."""
    return contours.filter((F.col("hole_area") > 0) & (F.col("vertices") == 4) & (F.col("w") * F.col("h")).between(0.02, 0.7) & (F.col("hole_area") >= 0.6 * F.col("outer_area")))


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The box's pixels, clipped to the image, at least one."""
    high, wide = image.shape[:2]
    x, y = min(max(0, int(box[0] * wide)), wide - 1), min(max(0, int(box[1] * high)), high - 1)
    return image[y : y + max(1, int(box[3] * high)), x : x + max(1, int(box[2] * wide))]
