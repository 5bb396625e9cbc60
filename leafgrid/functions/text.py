"""Text functions as column expressions. Lengths are in code points."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Unicode white space; \s alone is ASCII's.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
VISIBLE = "[^" + WS[1:]
CJK = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
KANA, HANGUL = r"[\x{3041}-\x{30FF}]", r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}]"
IDEOGRAPH = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
PRIVATE = r"[\x{E000}-\x{F8FF}]"
INVALID = r"[\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{FFFD}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
NOT_XML = r"[^\x{09}\x{0A}\x{0D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
FULL_WIDTH = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"
CODE_SYMBOLS = r"""[(){}\[\];=<>$#&|\\/*+'"`_]"""

LABELS = {
    "chapter": "ChapterTitle", "section": "SectionHeading", "subheading": "Subheading", "body": "Body", "caption": "Caption", "aside": "Aside",
    "pullquote": "PullQuote", "footnote": "Footnote", "header": "Header", "footer": "Footer", "pagenumber": "PageNumber", "decorative": "Decorative",
}
BLOCK_TYPES = "Unknown ChapterTitle SectionHeading Subheading Body Figure Caption Aside PullQuote Table Footnote Header Footer PageNumber Decorative Code".split()


def count_of(text: Column, pattern: str) -> Column:
    """Characters of the class that the pattern stands for."""
    return F.regexp_count(text, F.lit(pattern))


def nonspace(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(WS))


def is_blank(text: Column) -> Column:
    """The search ends at the first visible character."""
    return ~F.coalesce(text, F.lit("")).rlike(VISIBLE)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def word_ratio(text: Column) -> Column:
    """Letters and decimal digits among the characters that aren't white space; 0 if there are none."""
    seen = nonspace(text)
    return F.when(seen > 0, (seen - count_of(text, r"[^\p{L}\p{Nd}" + WS[1:])) / seen).otherwise(0.0)


def has_digit_run(text: Column, length: int = 16) -> Column:
    return text.rlike(f"(?:[0-9]{WS}*+){{{length - 1}}}[0-9]")


def join_pair(a: Column, b: Column) -> Column:
    """What the second of two line texts, neither empty, adds to the first: a space before it between ASCII characters, none beside others."""
    ends, starts = (F.substring(c, k, 1).between("!", "~") for c, k in ((a, -1), (b, 1)))
    return F.when(ends & starts, F.concat(F.lit(" "), b)).otherwise(b)


def joined(texts: Column) -> Column:
    """Line texts in one; null if one of them is. Each is looked at beside its neighbour, not beside all that went before."""
    shown = F.filter(texts, lambda x: F.length(x) > 0)
    before = F.slice(F.concat(F.array(F.lit("")), shown), 1, F.size(shown))
    return F.when(~F.exists(texts, lambda x: x.isNull()), F.array_join(F.zip_with(before, shown, join_pair), ""))


def normalised(text: Column) -> Column:
    return trimmed(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_XML, "")


def escaped(text: Column) -> Column:
    """For element content and attributes."""
    out = xml_safe(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def natural_width(text: Column) -> Column:
    """In ems: full-width characters count 1, others one half."""
    wide = count_of(text, FULL_WIDTH)
    return wide + (F.length(text) - wide) * 0.5


def number(x: Column) -> Column:
    """At most three decimals, no trailing zeros."""
    fixed = F.format_string("%.3f", F.round(x, 3))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def effective(corrected: Column, ocr: Column) -> Column:
    """The correction wins even if it is empty."""
    return F.coalesce(corrected, ocr)


def title_text(corrected: Column, ocr: Column) -> Column:
    """For titles: a blank correction doesn't count."""
    return F.when(is_blank(corrected), ocr).otherwise(corrected)


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").otherwise("image/png")


def source_name(source: Column) -> Column:
    return F.when(source == "PdfTextLayer", "pdf").when(source == "Ocr", "ocr").otherwise("unknown")


def label_key(block_type: Column) -> Column:
    """The key of a type; types without one are printed as body."""
    known = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
    return F.coalesce(F.element_at(known, block_type), F.lit("body"))


def type_of_label(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), key)


def type_ordinal(block_type: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in enumerate(BLOCK_TYPES) for x in (F.lit(v), F.lit(k))]), block_type)


def heading_level(block_type: Column) -> Column:
    return F.when(block_type == "ChapterTitle", 1).when(block_type == "SectionHeading", 2).when(block_type == "Subheading", 3)


def safe_correction(ocr: Column, corrected: Column) -> Column:
    """Whether a correction only mends single characters.

    Same length; no changed character in an ASCII run of three or more; no hiragana replaced by other hiragana; at most
    max(2, 35 %) characters changed, at least one.
    """
    n = F.length(ocr)
    return (n > 0) & (n == F.length(corrected)) & (ocr != corrected) & _mends(ocr, corrected)


def _code_points(text: str):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_RUN = np.array([chr(k) in string.ascii_letters + string.digits + "./:_-" for k in range(128)] + [False])


def mends(a: str, b: str) -> bool:
    """The rule on two different texts of one length."""
    a, b = _code_points(a), _code_points(b)
    at = np.flatnonzero(a != b)
    if len(at) > max(2.0, len(a) * 0.35):
        return False
    inside = np.r_[False, False, _RUN[np.minimum(a, 128)], False, False]
    one, two, three, four, five = (inside[at + k] for k in range(5))  # from two characters before to two after
    if (three & ((one & two) | (two & four) | (four & five))).any():
        return False
    hiragana = lambda v: (v >= 0x3041) & (v <= 0x309F)
    return not (hiragana(a[at]) & hiragana(b[at])).any()


@F.arrow_udf(returnType=BooleanType())
def _mends(ocr: pa.Array, corrected: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else len(a) == len(b) and mends(a, b) for a, b in zip(ocr.to_pylist(), corrected.to_pylist())], pa.bool_())
