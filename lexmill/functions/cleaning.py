"""Article cleaning as Column expressions; everything stays in the JVM."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup that cleaning removes, shortest match within one line.
# ``(?d)`` limits "." to stopping at "\n" only.
TEMPLATE_PATTERN = r"(?d)\{\{.*?\}\}"
CATEGORY_PATTERN = r"(?d)\[\[Catégorie:.*?\]\]"
HEADING_PATTERN = r"(?d)==.*?=="

# Code points that count as white space at either end of a text.
WHITESPACE = "".join(
    chr(point)
    for first, last in (
        (0x09, 0x0D),
        (0x1C, 0x20),
        (0x85, 0x85),
        (0xA0, 0xA0),
        (0x1680, 0x1680),
        (0x2000, 0x200A),
        (0x2028, 0x2029),
        (0x202F, 0x202F),
        (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for point in range(first, last + 1)
)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_templates(col) -> Column:
    return F.regexp_replace(_col(col), TEMPLATE_PATTERN, "")


def without_templates(text: str) -> str:
    """A text without balanced ``{{...}}``, however deep and over lines; an opening without an end stays."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    at = 0
    while True:
        begin, end = text.find("{{", at), text.find("}}", at)
        if end < 0 and begin < 0:
            break
        if 0 <= begin and (end < 0 or begin < end):
            opened.append(begin)
            at = begin + 2
        else:
            at = end + 2
            if opened:
                start = opened.pop()
                while spans and spans[-1][0] > start:
                    spans.pop()
                spans.append((start, at))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def strip_nested_templates(col) -> Column:
    """Like ``strip_templates`` for whole dumps: built-ins cannot match nested brackets."""

    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without_templates(t) if "{{" in t else t for t in texts.to_pylist()], pa.string())

    return strip(_col(col))


def strip_categories(col) -> Column:
    return F.regexp_replace(_col(col), CATEGORY_PATTERN, "")


def strip_headings(col) -> Column:
    return F.regexp_replace(_col(col), HEADING_PATTERN, "")


def strip_whitespace(col) -> Column:
    return F.btrim(_col(col), F.lit(WHITESPACE))


def lower_trim(col) -> Column:
    return strip_whitespace(F.lower(_col(col)))


def clean_text(col) -> Column:
    """Templates, category links, headings, then lower-case and trim."""
    return lower_trim(strip_headings(strip_categories(strip_templates(col))))


def is_blank(col) -> Column:
    return strip_whitespace(col) == ""
