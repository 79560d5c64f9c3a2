"""Removing tags and references, and telling prose from other content, as Column expressions.

Every pattern is linear in the text: none can run to the end of a text in vain
and start again behind its beginning.
"""

import html.entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col

# What holds no text. An opening without an end reaches to the end of the text.
COMMENT_PATTERN = r"(?s)<!--.*?(?:-->|\z)"
HIDDEN_PATTERN = r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\z)"
TAG_PATTERN = r"</?[A-Za-z!?][^<>]*>"
# Fixed value: a reference tag; the first group is the slash of one that closes itself.
_REF = re.compile(r"<ref\b[^<>]*?(/?)>|</ref\s*>", re.IGNORECASE)

_INVALID = "�"
# The common names are asked for first; the others are looked up in the published table that Python has.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}


def named_references() -> dict[str, str]:
    """``&name;`` to its characters, of all names that HTML has."""
    return {f"&{name}": text for name, text in html.entities.html5.items() if name.endswith(";")}


def _of_code(digits: Column, base: int) -> Column:
    """The character of a number; what is none becomes U+FFFD."""
    code = F.when(F.length(digits) <= 12, F.conv(digits, base, 10).cast("bigint"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # behind a byte order mark
    return F.when(valid, char).otherwise(_INVALID)


def decode_references(col) -> Column:
    """Decimal, hexadecimal and named character references that end in a semicolon; others stay.

    The text is cut before each ``&`` and behind each ``;``, so that every piece is a
    whole reference or none, and each is decoded once, however many there are.
    """
    text = _col(col)
    names = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")

    def decoded(piece: Column) -> Column:
        found = F.when(piece.rlike(r"^&#[0-9]+;$"), _of_code(F.regexp_extract(piece, "[0-9]+", 0), 10))
        found = found.when(piece.rlike(r"^&#[xX][0-9a-fA-F]+;$"), _of_code(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
        for name, value in _COMMON.items():
            found = found.when(piece == name, F.lit(value))
        return found.when(piece.rlike(r"^&[A-Za-z0-9]+;$"), F.coalesce(F.try_element_at(names, piece), piece)).otherwise(piece)

    pieces = F.transform(F.split(text, r"(?=&)|(?<=;)"), decoded)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def strip_tags(col, separator: str = " ") -> Column:
    """The text of HTML or XML: without comments, scripts, styles and tags, which become ``separator``, and with references decoded.

    A ``<`` that begins no tag, or has no ``>`` before the next ``<``, is text.
    """
    shown = F.regexp_replace(F.regexp_replace(_col(col), COMMENT_PATTERN, separator), HIDDEN_PATTERN, separator)
    return decode_references(F.regexp_replace(shown, TAG_PATTERN, separator))


def without_refs(text: str) -> str:
    """A text without ``<ref/>`` and balanced ``<ref>...</ref>``, however deep; an opening without an end stays, and so does an end alone."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    for tag in _REF.finditer(text):
        if tag.group().startswith("</"):
            if not opened:
                continue
            start = opened.pop()
        elif tag.group(1):
            start = tag.start()
        else:
            opened.append(tag.start())
            continue
        while spans and spans[-1][0] > start:
            spans.pop()
        spans.append((start, tag.end()))
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def strip_refs(col) -> Column:
    """References of wiki texts, with whatever is inside; built-ins cannot match nested ones.

    Templates within a reference go with it, and a reference within a template leaves
    the template whole, so it may be applied before ``strip_nested_templates`` or after.
    """

    @F.arrow_udf("string")
    def strip(texts: pa.Array) -> pa.Array:
        return pa.array([without_refs(text) if text and "<" in text else text for text in texts.to_pylist()], pa.string())

    return strip(_col(col))


def letter_share(col) -> Column:
    """Letters, of any script, among the characters that are no white space; 0 where there are none."""
    dense = F.regexp_replace(_col(col), r"[\s\p{Z}]", "")
    size = F.length(dense)
    return F.when(size > 0, F.length(F.regexp_replace(dense, r"[^\p{L}\p{M}]", "")) / size).otherwise(F.when(size == 0, F.lit(0.0)))
