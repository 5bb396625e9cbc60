import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.operators import chapters, chars, columns, edits, evaluation, images, layout, markup, pages, paragraphs
from leafgrid.functions import geometry as g
from leafgrid.plans import convert
from leafgrid.sources import decoders, projects
from test_lines import LINE, line

REGION = "doc_id long, page_no int, region_no int, x double, y double, w double, h double, kind string"


def order(boxes):
    x, y, w, h = np.array(boxes, float).reshape(-1, 4).T
    return columns.order_of(x, y, w, h, np.arange(len(x)), True)[1].tolist()


def rows(x, w, n=3, y=0.1, step=0.04, h=0.03):
    return [(x, y + k * step, w, h) for k in range(n)]


@pytest.mark.parametrize(
    "boxes",
    [rows(0.05, 0.35) + rows(0.55, 0.35), rows(0.05, 0.26) + rows(0.37, 0.26) + rows(0.69, 0.26), rows(0.1, 0.8), [(0.05, 0.05, 0.85, 0.03)] + rows(0.05, 0.35, 2) + rows(0.55, 0.35, 2), rows(0.05, 0.45) + rows(0.70, 0.25, 2), rows(0.07, 0.41, 40, 0.05, 0.02, 0.015) + rows(0.51, 0.41, 40, 0.05, 0.02, 0.015)],
)
def test_columns(boxes):
    shuffled = np.random.default_rng(1).permutation(len(boxes))
    got = order([boxes[k] for k in shuffled])
    assert [shuffled[k] for k in np.argsort(got)] == list(range(len(boxes)))


def test_column_tails():
    left = [(0.07, 0.05 + k * 0.04, 0.15 if k % 5 == 4 else 0.41, 0.03) for k in range(20)]
    right = [(0.51 + 0.0, 0.05 + k * 0.04, 0.18 if k % 5 == 4 else 0.41, 0.03) for k in range(20)]
    x, y, w, h = np.array(left + right).T
    assert [len(s) for s in columns.split(np.arange(40), x, w)] == [20, 20]


def test_no_columns():
    assert order([]) == []


def test_widest_agrees_with_query(spark):
    rng = np.random.default_rng(3)
    data = [(int(d), 1, float(x), float(w)) for d in range(30) for x, w in zip(rng.uniform(0, 0.7, 12), rng.uniform(0.05, 0.5, 12))]
    found = {r.doc_id: (r.start, r.end) for r in columns.gutters(spark.createDataFrame(data, "doc_id long, page_no int, x double, w double")).collect()}
    for d in range(30):
        x, w = (np.array([r[k] for r in data if r[0] == d]) for k in (2, 3))
        narrow = w <= 0.5
        want = columns.widest(x, w, narrow, 0.0, 1.0) if narrow.sum() >= 4 else None
        assert found.get(d) == pytest.approx(want) if want else d not in found


def classify(spark, lines, regions=()):
    out = layout.classify(spark.createDataFrame(lines, LINE), spark.createDataFrame(list(regions), REGION)).collect()
    return {r.line_no: r for r in out}


def body(n=3, h=0.0225):
    return [line(10 + k, "ordinary text of the page that is long enough", h=h, y=0.5 + 0.03 * k) for k in range(n)]


def test_types(spark):
    found = classify(spark, [line(0, "1 Beginning", h=0.05, y=0.1), line(1, "8", y=0.96, h=0.02), line(2, "Top", y=0.02), line(3, "X", h=0.08, y=0.12), *body()])
    assert [found[k].type for k in (0, 1, 2, 3, 10)] == ["ChapterTitle", "PageNumber", "Header", "Decorative", "Body"]
    assert found[0].heading_level == 1 and found[1].is_excluded


def test_low_title_is_decorative(spark):
    assert classify(spark, [line(0, "A large line", h=0.08, y=0.55), *body()])[0].type == "Decorative"


def test_bold(spark):
    lines = [line(k, "short line", h=0.02, y=0.3 + 0.03 * k, ink=0.15) for k in range(5)] + [line(9, "bold line", h=0.02, y=0.7, ink=0.30)]
    found = classify(spark, lines)
    assert found[9].type == "Subheading" and found[0].type == "Body"
    assert {r.type for r in classify(spark, [line(k, "short line", y=0.3 + 0.03 * k) for k in range(5)]).values()} == {"Body"}


def test_aside(spark):
    found = classify(spark, [line(0, "inside the box", x=0.12, y=0.30, w=0.5, h=0.03)], [(1, 1, 1, 0.1, 0.28, 0.6, 0.10, "Boxed")])
    assert found[0].type == "Aside"


def test_code_and_figure(spark):
    code = [line(0, "$ ls -l | grep 'x' > out", x=0.12, y=0.12, w=0.6, h=0.04), line(1, "for (i=0; i<3; i++) { run(i); }", x=0.12, y=0.17, w=0.6, h=0.04)]
    region = [(1, 1, 1, 0.10, 0.10, 0.65, 0.13, "Figure")]
    blocks = convert.reflow_blocks(spark.createDataFrame(code, LINE), spark.createDataFrame(region, REGION)).collect()
    assert [(b.type, "\n" in b.ocr_text) for b in blocks] == [("Code", True)]
    label = [line(0, "label", x=0.30, y=0.25, w=0.08, h=0.02), line(1, "text below the figure goes on here", y=0.6)]
    blocks = convert.reflow_blocks(spark.createDataFrame(label, LINE), spark.createDataFrame([(1, 1, 1, 0.10, 0.10, 0.65, 0.40, "Figure")], REGION)).orderBy("reading_order").collect()
    assert [b.type for b in blocks] == ["Figure", "Body"]


def test_caption_chain(spark):
    fig = [(1, 1, 1, 0.1, 0.10, 0.6, 0.30, "Figure")]
    lines = [line(k, f"caption line number {k}", x=0.1, w=0.6, y=0.42 + 0.03 * k, h=0.025) for k in range(4)] + [line(9, "body", y=0.7, h=0.025)]
    blocks = convert.reflow_blocks(spark.createDataFrame(lines, LINE), spark.createDataFrame(fig, REGION), merge=False).orderBy("reading_order").collect()
    assert [b.type for b in blocks] == ["Figure", "Caption", "Caption", "Caption", "Body", "Body"]
    assert {b.related_block_id for b in blocks if b.type == "Caption"} == {"p0001-b0001"}


BLOCK = "doc_id long, page_no int, block_id string, reading_order int, x double, y double, w double, h double, type string, ocr_text string, corrected_text string, conf double, source string, heading_level int, is_excluded boolean, is_edited boolean, requires_review boolean, image_path string, related_block_id string"


def block(n, text="text", kind="Body", y=None, x=0.1, w=0.8, h=0.02, conf=0.9, corrected=None, source="Ocr", excluded=False, edited=False, page=1, doc=1, image=None, related=None):
    return (doc, page, f"p{page:04d}-b{n + 1:04d}", n, x, 0.1 + 0.025 * n if y is None else y, w, h, kind, text, corrected, conf, source, None, excluded, edited, False, image, related)


def test_paragraphs(spark):
    merge = lambda rows: paragraphs.merge(spark.createDataFrame(rows, BLOCK)).orderBy("reading_order").collect()
    one = merge([block(0, "日本"), block(1, "語の"), block(2, "文")])
    assert len(one) == 1 and one[0].ocr_text == "日本語の文" and one[0].h == pytest.approx(0.07)
    assert [r.reading_order for r in merge([block(0), block(1, y=0.19), block(2, x=0.14, y=0.215)])] == [0, 1, 2]
    assert len(merge([block(0, kind="SectionHeading"), block(1, x=0.05, w=0.3), block(2, x=0.6, w=0.3), block(3, kind="Aside")])) == 4
    assert len(merge([block(0), block(1, edited=True)])) == 2


def test_drop_cap(spark):
    rows = [block(0, "O", x=0.05, y=0.10, w=0.05, h=0.06), block(1, "nce upon a time", x=0.12, y=0.11), block(2, "there was more", x=0.12, y=0.14)]
    found = paragraphs.drop_caps(spark.createDataFrame(rows, BLOCK)).collect()
    assert [(r.cap_id, r.target_id, r.text) for r in found] == [("p0001-b0001", "p0001-b0002", "Once upon a time")]
    twice = [*rows, block(3, "T", x=0.04, y=0.10, w=0.05, h=0.06)]
    assert {r.target_id for r in paragraphs.drop_caps(spark.createDataFrame(twice, BLOCK)).collect()} == {"p0001-b0002", "p0001-b0003"}


def test_drop_cap_joins_its_line(spark):
    cap = block(0, " O ", x=0.05, y=0.10, w=0.05, h=0.06, conf=0.4)
    rows = [cap, block(1, "nce upon", x=0.12, y=0.11), block(2, "a time", x=0.12, y=0.135)]
    made = spark.createDataFrame(rows, BLOCK)
    got = paragraphs.merge(made).collect()
    assert [(r.ocr_text, r.block_id, r.conf, r.reading_order) for r in got] == [("Once upon a time", "p0001-b0002", 0.4, 0)] and got[0].x == 0.12
    edited = [cap, block(1, "nce upon", x=0.12, y=0.11, edited=True), block(2, "a time", x=0.12, y=0.135)]
    assert paragraphs.drop_caps(spark.createDataFrame(edited, BLOCK)).count() == 0
    assert len(paragraphs.merge(spark.createDataFrame(edited, BLOCK)).collect()) == 3
    assert len(paragraphs.merge(spark.createDataFrame([block(0, w=0.0), block(1)], BLOCK)).collect()) == 2  # a line without width


def test_status_and_confidence(spark):
    blocks = spark.createDataFrame([block(0), block(0, page=3)], BLOCK)
    p = spark.createDataFrame([(1, k) for k in (1, 2, 3)], "doc_id long, page_no int")
    assert {r.page_no: r.status for r in pages.page_status(p, blocks).collect()} == {1: "OcrCompleted", 2: "Error", 3: "OcrCompleted"}
    found = spark.createDataFrame([(1, 1, [0.5, 1.0]), (1, 1, [0.25]), (1, 1, []), (1, 2, [])], "doc_id long, page_no int, scores array<double>")
    assert {r.page_no: r.confidence for r in evaluation.page_confidence(found).collect()} == {1: 0.5, 2: 0.0}


def test_chapters(spark):
    get = lambda rows: [(r.title, len(r.block_ids)) for r in chapters.chapters(spark.createDataFrame(rows, BLOCK)).orderBy("chapter_no").collect()]
    title = lambda n, **k: block(n, f"T{n}", "ChapterTitle", **k)
    assert get([title(0), block(1), block(2, kind="SectionHeading"), block(3), title(4), block(5)]) == [("T0", 3), ("T4", 1)]
    assert get([title(0), block(1), title(2), block(3)]) == [("T0", 3)]
    assert get([block(0), title(1), block(2)]) == [("Front matter", 1), ("T1", 1)]
    assert get([title(0, corrected="Mended"), block(1)]) == [("Mended", 1)]
    assert get([title(0, corrected=" "), block(1)]) == [("T0", 1)]
    assert get([block(0, page=2), block(0, page=1), block(1, page=1, excluded=True)]) == [("Front matter", 2)]


def test_chapter_walk_is_sequential(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for doc in range(40):
        kinds = ["ChapterTitle" if u < 0.3 else "Body" for u in rng.random(25)]
        rows += [block(n, f"T{n}", k, doc=doc) for n, k in enumerate(kinds)]
        parts: list[list] = []
        front = False
        for n, k in enumerate(kinds):
            if k == "ChapterTitle" and (not parts or front or parts[-1][1] >= 3):
                parts.append([f"T{n}", 0])
                front = False
            else:
                if not parts:
                    parts.append(["Front matter", 0])
                    front = True
                parts[-1][1] += 1
        want[doc] = [tuple(p) for p in parts]
    got = {d: [] for d in want}
    for r in chapters.chapters(spark.createDataFrame(rows, BLOCK)).orderBy("doc_id", "chapter_no").collect():
        got[r.doc_id].append((r.title, len(r.block_ids)))
    assert got == want


def test_evaluation(spark):
    rows = [block(0, "title", "SectionHeading"), block(1, "hello world!", conf=0.7), block(2, "label", "Figure", image="a.jpg"), block(3, "", "Figure"), block(4, "12", "PageNumber", excluded=True)]
    r = evaluation.page_evaluation(spark.createDataFrame(rows, BLOCK)).first()
    assert (r.chars_included, r.chars_excluded, r.chars_dropped, r.coverage, r.figures, r.figures_with_image, r.headings, r.low_confidence) == (21, 2, 0, 1.0, 2, 1, 1, 1)
    empty = evaluation.document_evaluation(spark.createDataFrame([(1, 1)], "doc_id long, page_no int"), evaluation.page_evaluation(spark.createDataFrame([], BLOCK))).first()
    assert (empty.pages, empty.pages_with_blocks, empty.coverage, empty.figure_rate) == (1, 0, 1.0, 1.0)


def test_labels(spark):
    b = spark.createDataFrame([block(k) for k in range(4)], BLOCK)
    answer = '{"blocks":[{"id":"p0001-b0001","type":"footer","confidence":0.9},{"id":"nope","type":"body","confidence":0.9},7,{"id":"p0001-b0002","type":"section","headingLevel":1000000,"confidence":1},{"id":"p0001-b0002","type":"section","headingLevel":2,"confidence":1},{"id":"p0001-b0003","type":"section","headingLevel":2,"confidence":0.5}]}'
    a = spark.createDataFrame([(1, 1, 0, answer), (1, 1, 1, "no json")], "doc_id long, page_no int, chunk_no int, json string")
    got = {r.block_id[-1]: r for r in edits.apply_labels(b, edits.labels(a, b)).collect()}
    assert (got["1"].type, got["1"].is_excluded, got["1"].requires_review) == ("Footer", False, True)
    assert got["2"].type == "Body" and (got["3"].type, got["3"].heading_level) == ("SectionHeading", 2)


def test_overlay_and_save(spark, tmp_path):
    b = spark.createDataFrame([block(0, "one"), block(1, "two")], BLOCK)
    projects.save(b, f"{tmp_path}/p")
    spark.createDataFrame([(1, "p0001-b0002", "changed")], "doc_id long, block_id string, text string").write.mode("overwrite").json(f"{tmp_path}/p/texts")
    projects.save(b, f"{tmp_path}/p")  # adds the first block's text, keeps the changed one
    got = {r.block_id: r for r in projects.load(spark, f"{tmp_path}/p", b.schema.simpleString()[7:-1].replace(":", " ")).collect()}
    assert (got["p0001-b0002"].corrected_text, got["p0001-b0002"].is_edited) == ("changed", True)
    assert (got["p0001-b0001"].corrected_text, got["p0001-b0001"].is_edited) == (None, False)


def test_paper_profile(spark):
    stats = lambda rows: pages.paper_profile(spark.createDataFrame([(1, k, float(x), 0.6, x - 2.0, x - 1.0, float(x)) for k, x in enumerate(rows)], "doc_id long, page_no int, luminance double, share double, b double, g double, r double"))
    got = stats([241, 242, 243, 242, 190]).first()
    assert 241 <= got.luminance <= 244 and 239 <= got.b <= 242
    assert stats([242, 243]).count() == 0
    assert stats([180, 200, 240]).count() == 1  # fewer than three inliers: all count


def test_unrotated(spark):
    df = spark.createDataFrame([(0.4, 0.45, 0.2, 0.1, 0.0), (0.4, 0.45, 0.2, 0.1, -3.0)], "x double, y double, w double, h double, a double")
    box = g.unrotated(g.box(), F.col("a"), F.lit(1000.0), F.lit(1400.0))
    same, turned = df.select(*[v.alias(c) for c, v in zip("xywh", box)]).collect()
    assert tuple(same) == (0.4, 0.45, 0.2, 0.1)
    assert turned.x + turned.w / 2 == pytest.approx(0.5, abs=1e-3) and turned.w >= 0.2 and turned.h >= 0.1


def test_spans(spark):
    def span(text, w, h, mode="Horizontal", width=600, height=800):
        df = spark.createDataFrame([block(0, text, w=w, h=h)], BLOCK).withColumn("width", F.lit(width)).withColumn("height", F.lit(height)).withColumn("writing_mode", F.lit(mode))
        return markup.spans(df).first()["span"]

    assert "scaleX(0." in span("全" * 11, 0.2, 0.026)
    assert span("a" * 20, 0.5, 0.02).split("style=")[1].split(">")[0] == span("全" * 10, 0.5, 0.02).split("style=")[1].split(">")[0]
    assert "writing-mode" in span("縦書き", 0.03, 0.4, "Vertical") and "scaleY" in span("縦書き", 0.03, 0.4, "Vertical")
    assert "writing-mode" not in span("wide", 0.4, 0.03, "Vertical")


def test_package(spark):
    import io
    import zipfile

    b = spark.createDataFrame([block(0, "Start", "ChapterTitle"), block(1, "a < b"), block(2, "gone", excluded=True), block(3, "ocr", corrected="mended")], BLOCK)
    p = spark.createDataFrame([(1, "T & U", "Me", " ", "en", "Horizontal", "id1")], "doc_id long, title string, author string, publisher string, language string, writing_mode string, project_id string")
    files = convert.reflow_book(b, p).withColumn("content", F.encode("content", "utf-8"))
    z = zipfile.ZipFile(io.BytesIO(bytes(projects.packed(files).first()["epub"])))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    chapter = z.read("OEBPS/chapters/chapter-001.xhtml").decode()
    assert "a &lt; b" in chapter and "mended" in chapter and "gone" not in chapter and "ocr" not in chapter
    opf = z.read("OEBPS/content.opf").decode()
    assert "T &amp; U" in opf and "dc:creator" in opf and "dc:publisher" not in opf


def test_fixed_page(spark):
    b = spark.createDataFrame([block(0, "here", x=0.1, y=0.2, w=0.5, h=0.05)], BLOCK).withColumn("width", F.lit(612)).withColumn("height", F.lit(792)).withColumn("writing_mode", F.lit("Horizontal"))
    made = markup.spans(b)
    page = markup.fixed_pages(spark.createDataFrame([(1, 1, 612, 792, "images/p1.jpg")], "doc_id long, page_no int, width int, height int, image string"), made).first()
    assert "left:61.2px" in page.content and "top:158.4px" in page.content and page.path == "pages/page-0001.xhtml"


PAGES = "doc_id long, page_no int, width int, height int, original_image string, processed_image string, writing_mode string"


def opened(spark, files):
    import io
    import zipfile

    return {r.doc_id: zipfile.ZipFile(io.BytesIO(bytes(r.epub))) for r in projects.packed(files).collect()}


def made_projects(spark, *ids):
    return spark.createDataFrame([(k, "T & U", "Me", " ", "en", "Vertical", f"id{k}") for k in ids], "doc_id long, title string, author string, publisher string, language string, writing_mode string, project_id string")


def test_reflow_book_with_cover_and_images(spark):
    b = spark.createDataFrame([block(0, "Start", "ChapterTitle"), block(1, "", "Figure", image="work/f1.png"), block(2, "", "Figure", image="work/f1.png"), block(3, "text"), block(0, "Other", "ChapterTitle", doc=2)], BLOCK)
    p = spark.createDataFrame([(1, 2, 612, 792, "in/p2.jpg", None, "Horizontal"), (1, 1, 612, 792, "in/p1.jpg", "in/p1-clean.png", "Horizontal"), (2, 1, 612, 792, None, None, "Horizontal")], PAGES)
    contents = spark.createDataFrame([("work/f1.png", b"figure"), ("in/p1-clean.png", b"cover")], "path string, content binary")
    files = convert.reflow_book(b, made_projects(spark, 1, 2), pages=p)
    cover = convert.cover_images(p)
    z = opened(spark, convert.with_images(files, convert.book_images(b).unionByName(cover), contents))
    assert z[1].read("OEBPS/images/f1.png") == b"figure" and z[1].read("OEBPS/images/cover.png") == b"cover"
    assert 'src="images/cover.png" alt="T &amp; U"' in z[1].read("OEBPS/cover.xhtml").decode() and 'src="../images/f1.png"' in z[1].read("OEBPS/chapters/chapter-001.xhtml").decode()
    opf = z[1].read("OEBPS/content.opf").decode()
    assert opf.count('href="images/f1.png"') == 1 and 'href="images/cover.png" media-type="image/png" properties="cover-image"' in opf and opf.index('idref="cover"') < opf.index('idref="chapter-001"')
    assert "cover.xhtml" in z[1].read("OEBPS/nav.xhtml").decode()
    assert "OEBPS/cover.xhtml" not in z[2].namelist() and "cover" not in z[2].read("OEBPS/nav.xhtml").decode() + z[2].read("OEBPS/content.opf").decode()


def test_fixed_book(spark):
    b = spark.createDataFrame([block(0, "here", x=0.1, y=0.2, w=0.5, h=0.05), block(0, "there", page=2)], BLOCK)
    p = spark.createDataFrame([(1, 1, 612, 792, "in/a.jpg", None, "Vertical"), (1, 2, 612, 792, "in/b.jpg", "in/b2.png", "Horizontal"), (1, 3, 612, 792, "in/c.jpg", None, "Horizontal")], PAGES)
    contents = spark.createDataFrame([("in/a.jpg", b"A"), ("in/b2.png", b"B"), ("in/c.jpg", b"C")], "path string, content binary")
    files = convert.with_images(convert.fixed_book(p, b, made_projects(spark, 1)), convert.page_images(p), contents)
    z = opened(spark, files)[1]
    assert [n for n in z.namelist() if "pages/" in n] == [f"OEBPS/pages/page-{k:04}.xhtml" for k in (1, 2, 3)]
    assert z.read("OEBPS/images/page-0002.png") == b"B" and 'src="../images/page-0002.png"' in z.read("OEBPS/pages/page-0002.xhtml").decode()
    assert "there" in z.read("OEBPS/pages/page-0002.xhtml").decode() and "<span" not in z.read("OEBPS/pages/page-0003.xhtml").decode()
    opf = z.read("OEBPS/content.opf").decode()
    assert "pre-paginated" in opf and 'page-progression-direction="rtl"' in opf and opf.count("<itemref") == 3
    with pytest.raises(ValueError, match="needs pages; 9"):
        convert.fixed_book(p, b, made_projects(spark, 1, 9))


def test_transcode(spark):
    df = spark.createDataFrame([("a.png", 2600, 3600, 10**6), ("b.webp", 100, 100, 10**6), ("c.gif", 1, 1, 1)], "path string, width int, height int, bytes long")
    a, b, c = images.transcode_rule(df).collect()
    assert (a.media_type, a.target_height, a.transcode) == ("image/jpeg", 2200, True) and not b.transcode and c.error
    assert images.transcode_rule(df, 0).first()["target_height"] == 3600


def test_images():
    page = np.full((800, 600, 3), 235, np.uint8)
    page[100:110, 50:550] = page[200:203, 50:550] = 20
    thick, thin = images.ink_density(page, [(0.08, 0.12, 0.84, 0.025), (0.08, 0.245, 0.84, 0.025)])
    assert thick > 2 * thin
    stats = images.paper_stats(page)
    assert stats[0] == 235 and stats[1] > 0.9
    white = images.enhance(page, stats[2:])
    assert white[400, 300].min() >= 250 and white[105, 300].max() <= 80
    dark = np.full((50, 50, 3), 60, np.uint8)
    assert (images.enhance(dark, None) == dark).all()
    stripes = np.full((800, 600), 255, np.uint8)
    for y in range(60, 740, 24):
        stripes[y : y + 8, 60:540] = 0
    assert images.skew(stripes) is None
    found = images.skew(images.rotated(stripes, 2.5))
    assert found is not None and abs(abs(found) - 2.5) <= 0.4
    assert images.skew(np.full((800, 600), 255, np.uint8)) is None
    fig = np.full((400, 400), 255, np.uint8)
    fig[100:250, 80:300] = 0
    (x, y, w, h), = images.figure_boxes(fig, [])
    assert abs(x - 0.2) < 0.06 and abs(y - 0.25) < 0.06 and abs(w - 0.55) < 0.1
    assert images.flatten(np.zeros((1, 1, 4), np.uint8)).tolist() == [[[255, 255, 255]]]


def test_image_stages(spark):
    page = np.full((200, 160, 3), 250, np.uint8)
    page[40:44, 30:130] = page[140:144, 30:130] = page[40:144, 30:34] = page[40:144, 126:130] = 0  # a frame
    page[60:64, 50:110] = 10
    tilted = images.rotated(np.where(np.arange(400)[:, None, None] % 20 < 8, 0, 255).astype(np.uint8) * np.ones((1, 300, 3), np.uint8), -3.0)
    rows = [(1, 1, 160, 200, page.tobytes()), (2, 1, 300, 400, tilted.tobytes()), (3, 1, None, None, None)]
    imgs = spark.createDataFrame(rows, "doc_id long, page_no int, width int, height int, pixels binary")
    lines = spark.createDataFrame([(1, 1, 0, 50 / 160, 0.3, 60 / 160, 0.02), (1, 1, 1, 0.05, 0.8, 0.5, 0.1)], "doc_id long, page_no int, line_no int, x double, y double, w double, h double")
    stats = {r.doc_id: r for r in images.page_paper_stats(imgs).collect()}
    assert set(stats) == {1, 2} and stats[1].luminance == 250 and stats[1].b == 250
    assert {r.line_no: r.ink for r in images.line_ink(imgs, lines).collect()} == {0: 1.0, 1: 0.0}
    assert {r.doc_id: r.angle is None for r in images.page_skew(imgs).collect()} == {1: True, 2: False}
    level = {r.doc_id: r for r in images.straightened(imgs).collect()}
    assert level[1].angle == 0.0 and bytes(level[1].pixels) == page.tobytes() and abs(level[2].angle - 3.0) < 0.5
    white = images.enhanced(imgs, spark.createDataFrame([(1, 240.0, 240.0, 240.0)], "doc_id long, b double, g double, r double"))
    assert {r.doc_id: max(r.pixels) for r in white.collect()}[1] == 255
    assert [r.kind for r in images.page_regions(imgs.filter("doc_id = 1"), lines.limit(0)).collect()] == ["Figure"]  # the frame's own edges are a figure, which goes first
    assert images.frame_boxes(page) == [(30 / 160, 40 / 200, 100 / 160, 104 / 200)]
    page[60:120, 50:110] = 0  # filled: its hollow is small
    page[44:140, 34:126] = 0
    assert images.frame_boxes(page) == []


def test_pictures_of_blocks(spark):
    page = np.arange(40 * 60 * 3, dtype=np.uint32).astype(np.uint8).reshape(40, 60, 3)
    imgs = spark.createDataFrame([(1, 1, 60, 40, page.tobytes())], "doc_id long, page_no int, width int, height int, pixels binary")
    b = spark.createDataFrame([block(0, kind="Figure", x=0.5, y=0.5, w=0.25, h=0.25), block(1, x=0.0, y=0.0, w=0.5, h=0.5, excluded=True)], BLOCK)
    made = images.figure_images(imgs, b, lambda a, q: bytes([q]) + a.tobytes()).collect()
    assert [(r.block_id, bytes(r.content)) for r in made] == [("p0001-b0001", bytes([90]) + page[20:30, 30:45].tobytes())]
    out = images.overlays(imgs, b).first()
    drawn = np.frombuffer(bytes(out.pixels), np.uint8).reshape(40, 60, 3)
    shade = [int(images.COLOURS["Figure"][k : k + 2], 16) for k in (5, 3, 1)]
    assert drawn[22, 40].tolist() == drawn[20, 30].tolist() == shade and drawn[24, 40].tolist() == page[24, 40].tolist()
    assert (drawn[1:19, 1:29] == page[1:19, 1:29]).all() and (drawn[0, 5] != page[0, 5]).any()
    assert (images.overlays(imgs, b, most=30).first().width, images.overlays(imgs, b, most=30).first().height) == (30, 20)
    contents = spark.createDataFrame([("a.png", b"A"), ("b.jpg", b"B")], "path string, content binary")
    rules = images.transcode_rule(spark.createDataFrame([("a.png", 4000, 2000, 10), ("b.jpg", 100, 100, 10)], "path string, width int, height int, bytes long"))
    encoder = lambda c, w, h, q: c + f"{w}x{h}@{q}".encode()
    assert {r.path: bytes(r.content) for r in images.transcoded(contents, rules, encoder, 300).collect()} == {"a.png": b"A2200x1100@100", "b.jpg": b"B"}
    assert {r.path: bytes(r.content) for r in images.transcoded(contents, rules, None).collect()} == {"a.png": b"A", "b.jpg": b"B"}


def test_models(tmp_path):
    import hashlib

    from leafgrid.sources import models

    calls = []

    def fetch(path):
        calls.append(path)
        with open(path, "wb") as f:
            f.write(b"weights")

    want = hashlib.sha256(b"weights").hexdigest()
    path = models.provide("m.onnx", str(tmp_path / "cache"), want.upper(), fetch)
    assert open(path, "rb").read() == b"weights" and models.provide("m.onnx", str(tmp_path / "cache"), want, fetch) == path and len(calls) == 1
    with pytest.raises(ValueError, match="digest"):
        models.provide("other", str(tmp_path / "cache"), "0" * 64, fetch)
    assert [p.name for p in (tmp_path / "cache").iterdir()] == ["m.onnx"]
    assert models.available(lambda: None) and not models.available(lambda: 1 / 0)


def test_characters():
    word = lambda s, x, y: [(x + 10 * k, y, x + 10 * k + 9, y + 12) for k in range(len(s))]
    text = "abcd" + "efg" + "12" + "xyz"
    boxes = word("abcd", 0, 0) + word("efg", 48, 1) + word("12", 300, 0) + word("xyz", 0, 40)
    got = chars.lines_of_page(np.array(boxes, float), list(text), np.full(len(text), 12.0), 612, 792)
    assert [r[4] for r in got] == ["abcd efg", "12", "xyz"]


def test_decoders(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"!bad")

    def decoder(path, content):
        if content.startswith(b"!"):
            raise ValueError("unreadable")
        return [(1, n, 612, 792, t) for n, t in enumerate(content.decode().split("\n"), 1)]

    out = decoders.decode(decoders.files(spark, str(tmp_path)), decoder, decoders.PAGES).orderBy("path", "page_no").collect()
    assert [(r.raw_text, r.error) for r in out] == [("one", None), ("two", None), (None, "ValueError: unreadable")]


def test_images_that_cannot_be_read(spark):
    found = spark.createDataFrame([(1, 1, b"ab"), (1, 2, b""), (1, 3, b"!")], "doc_id long, page_no int, content binary")

    def decoder(content):
        if content == b"!":
            raise ValueError("broken")
        return np.full((2, 3, 3), content[0], np.uint8) if content else None

    all_ = {r.page_no: (r.width, r.height, r.error) for r in decoders.decoded_images(found, decoder, "error").collect()}
    assert all_ == {1: (3, 2, None), 2: (None, None, "empty image"), 3: (None, None, "ValueError: broken")}
    assert [bytes(r.pixels) for r in decoders.decoded_images(found, decoder).collect()] == [b"a" * 18]
    with pytest.raises(ValueError):
        decoders.decoded_images(found, decoder, "other")


def test_recognise_and_ask(spark):
    nothing = decoders.recognise(spark.createDataFrame([(1, 1, b"x")], "doc_id long, page_no int, content binary"), lambda c: [([(10, 20), (110, 40)], "hello", [0.8], 0, 0)]).first()
    assert (nothing.x, nothing.w) == (0.0, 0.0)
    image = spark.createDataFrame([(1, 1, b"x")], "doc_id long, page_no int, content binary")
    got = decoders.recognise(image, lambda c: [([(10, 20), (110, 20), (110, 40), (10, 40)], "hello", [0.8, 1.0], 1000, 1000), ([(0, 0), (1, 1)], " ", [], 1000, 1000)]).collect()
    assert [(r.text, r.x, r.w, r.conf) for r in got] == [("hello", 0.01, 0.1, 0.9)]
    asked = decoders.ask(spark.createDataFrame([(1, 1, 0, "good"), (1, 1, 1, "bad")], "doc_id long, page_no int, chunk_no int, prompt string"), lambda p: '{"blocks":[]}' if p == "good" else "{")
    assert decoders.chunk_status(asked).first()["status"] == "partial"


def test_project_json(spark):
    import json

    made = projects.project_json(spark.createDataFrame([block(1, "b"), block(0, "a", kind="Figure")], BLOCK)).first()
    assert [(b["reading_order"], b["type"], b["ocr_text"]) for b in json.loads(made.json)["blocks"]] == [(0, "Figure", "a"), (1, "Body", "b")] and "\n  " in made.json


def test_stream(spark, tmp_path, data):
    from leafgrid.sources.tables import lines_of
    from leafgrid.operators import lines
    from leafgrid.streaming import pages as stream

    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    plan = lambda b: lines.junk_counts(lines_of(b))
    q = stream.run(stream.documents(spark, f"{tmp_path}/in", "doc_id long, text string", 1), plan, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select("doc_id", "kept").collect()) == sorted(plan(docs).select("doc_id", "kept").collect())


def test_observed_and_names(spark):
    df, watch = pages.observed(spark.createDataFrame([block(0, conf=0.5), block(1)], BLOCK))
    assert df.count() == 2 and watch.get == {"blocks": 2, "review": 0, "low_confidence": 1}
    one = spark.createDataFrame([("a/b.c.pdf",)], "path string")
    assert [pages.output_names(one, *x).first()["out"] for x in ((), ("f.epub", True), ("d/",))] == ["a/b.c.epub", "f.epub", "d/b.c.epub"]
    assert images.crop(np.zeros((10, 20)), (0.5, 0.5, 1.0, 1.0)).shape == (5, 10)


def test_cli(spark, data, tmp_path):
    from leafgrid import cli

    docs = f"{data}/documents.parquet"
    assert cli.main(["analyze", docs, "--documents", "-o", f"{tmp_path}/p", "--layout", "reflow"]) == 0
    assert cli.main(["export", f"{tmp_path}/p", "-o", f"{tmp_path}/x", "--format", "blocks"]) == 0
    import glob
    import zipfile

    for verb in (["export", f"{tmp_path}/p", "--layout", "reflow"], ["convert", docs, "--documents", "--vertical", "--max-pages", "3"], ["convert", docs, "--documents", "--layout", "reflow", "--image-quality", "300"]):
        assert cli.main([*verb, "-o", f"{tmp_path}/books"]) == 0
        made = glob.glob(f"{tmp_path}/books/*.epub")
        assert made and zipfile.ZipFile(made[0]).namelist()[0] == "mimetype"
    assert spark.read.parquet(f"{tmp_path}/x").count() == spark.read.json(f"{tmp_path}/p/blocks").count() > 0
    assert cli.main(["evaluate", docs, "--documents", "-o", f"{tmp_path}/e"]) == 0
    assert spark.read.text(f"{tmp_path}/e/html").count() == spark.read.parquet(docs).count()
    assert cli.main(["convert", f"{tmp_path}", "-o", f"{tmp_path}/n"]) == 1
    with pytest.raises(SystemExit):
        cli.parse(["convert", "/no/such/file", "-o", "x"])


def plain_lines(c, text, sizes, width):
    """Characters in rows one after the other, as the rule says it; the texts of all segments."""
    rows = []
    for k in sorted(range(len(c)), key=lambda k: (c[k][1], c[k][0])):
        _, top, _, bottom = c[k]
        for row in reversed(rows):
            if min(row[1], bottom) - max(row[0], top) > 0.5 * min(bottom - top, row[1] - row[0]):
                row[0], row[1] = min(row[0], top), max(row[1], bottom)
                row[2].append(k)
                break
            if row[1] < top:
                rows.append([top, bottom, [k]])
                break
        else:
            rows.append([top, bottom, [k]])
    median = lambda v: sorted(v)[len(v) // 2]
    out = []
    for _, _, at in rows:
        at.sort(key=lambda k: c[k][0])
        high = median([c[k][3] - c[k][1] for k in at])
        parts = [[at[0]]]
        for a, b in zip(at, at[1:]):
            parts.append([b]) if c[b][0] - c[a][2] > max(1.5 * high, 0.02 * width) else parts[-1].append(b)
        for p in parts:
            east = [bool(chars._CJK.match(text[k])) for k in p]
            pairs = [(c[b][0] - c[a][2], not x and not y, a, b) for a, b, x, y in zip(p, p[1:], east, east[1:])]
            em = median([sizes[k] for k in p if sizes[k] > 0] or [high])
            open_ = [gap for gap, western, *_ in pairs if western and gap > 0]
            least = min(0.28 * em, max(0.12 * em, 1.8 * median(open_))) if open_ else 0.28 * em
            plain = sum(east) >= 0.2 * len(p) or len(p) < 2
            space = [not plain and western and gap > least and not (text[a].isdigit() and text[b].isdigit()) for gap, western, a, b in pairs]
            out.append((min(c[k][1] for k in p), min(c[k][0] for k in p), text[p[0]] + "".join(" " * s + text[k] for s, k in zip(space, p[1:]))))
    return [r[2] for r in sorted(out, key=lambda r: r[:2])]


@pytest.mark.parametrize("ligature", ["x", "ffi"])
def test_characters_by_the_rule(ligature):
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 400):
        left, top = r.integers(0, 120, n) * 5.0, r.integers(0, 14, n) * 6.5
        c = np.column_stack([left, top, left + r.choice([4.0, 5.0, 9.0], n), top + r.choice([6.0, 12.0, 30.0], n, p=[0.2, 0.7, 0.1])])
        text, sizes = r.choice(list("ab12漢") + [ligature], n).tolist(), r.choice([0.0, 12.0, 14.0], n)
        assert [x[4] for x in chars.lines_of_page(c, text, sizes, 612, 792)] == plain_lines(c.tolist(), text, sizes.tolist(), 612)


def test_characters_do_not_travel(spark, tmp_path):
    """a row and a Python object for each character took more memory than an executor has."""
    from leafgrid.queries.document_queries import character_lines, grid

    texts = [(1, "one two  three 1 2　x"), (2, "漢字" * 100), (3, ""), (4, None), (5, "a" * 61)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = character_lines(spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.line_no): r.text for r in df.collect()}
    rows = [(d, d, k, x, *box, 12.0) for d, s in texts if s for k, (x, box) in enumerate(zip(grid(s)[0], grid(s)[1].tolist()))]
    table = spark.createDataFrame(rows, decoders.CHARS)
    pages_ = spark.createDataFrame([(d, d, 612, 792) for d, _ in texts], "doc_id long, page_no int, width int, height int")
    assert got == {(r.doc_id, r.line_no): r.text for r in chars.text_lines(table, pages_).collect()}
    assert (got[1, 0], got[1, 1], got[5, 1]) == ("one two", "three 12 x", "a")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_files_share_a_frame(spark):
    """each file came back in a frame of its own, at milliseconds a file."""
    made = spark.sparkContext.accumulator(0)
    files = spark.range(300).selectExpr("cast(id as string) path", "encode(cast(id as string), 'utf-8') content").coalesce(1)

    def decoder(path, content):
        if path == "7":
            raise ValueError("bad")
        return [(int(path), None if path == "8" else 2**60 + int(path), 0.5)]

    def counted(frames):
        for f in frames:
            made.add(1)
            yield f

    got = decoders.decode(files, decoder, "n long, big long, v double").mapInArrow(counted, "n long, big long, v double, path string, error string").collect()
    assert made.value <= 5
    assert [(r.n, r.big, r.error) for r in got if int(r.path) in (7, 8, 9)] == [(None, None, "ValueError: bad"), (8, None, None), (9, 2**60 + 9, None)]


def test_initials_without_a_join(spark, data):
    """the page's rows were typed four times and shuffled eight times to find the initials."""
    from leafgrid.queries.layout_queries import paragraph_merge

    df = paragraph_merge(spark, data)
    assert "Join" not in plan_of(df) and exchanges(df) <= 1
    df = spark.createDataFrame([(["ab", "", "cd", "日", "e\r", "f"],), (["", ""],), ([],), (["a", None],)], "t array<string>")
    from leafgrid.functions import text as t

    assert [r.j for r in df.select(t.joined(F.col("t")).alias("j")).collect()] == ["ab cd日e\rf", "", "", None]


def test_chapters_in_one_shuffle(spark, data):
    """F4, F5, F8: all texts went through five shuffles to find the chapters."""
    from leafgrid.queries.layout_queries import books

    df = chapters.chapters(books(spark, data))
    assert "Join" not in plan_of(df) and exchanges(df) <= 2
    rows = [(1, 1, k, f"b{k}", "ChapterTitle" if k in (0, 2, 4, 9) else "Body", f"t{k}", None, k == 3) for k in range(11)] + [(2, 1, 0, "x", "Body", "t", None, False), (3, 1, 0, "y", "ChapterTitle", "t", " ", False)]
    b = spark.createDataFrame(rows, "doc_id long, page_no int, reading_order int, block_id string, type string, ocr_text string, corrected_text string, is_excluded boolean")
    got = {(r.doc_id, r.chapter_no): (r.title, r.block_ids) for r in chapters.chapters(b).collect()}
    assert got == {(1, 1): ("t0", ["b1", "b2", "b4", "b5", "b6", "b7", "b8"]), (1, 2): ("t9", ["b10"]), (2, 1): ("Front matter", ["x"]), (3, 1): ("t", [])}
