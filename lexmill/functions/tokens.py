"""Text normalisation, word splitting and byte symbols as Column expressions."""

import functools
import operator
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col

# Special tokens; their ids are their positions.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[BOS]", "[EOS]"]
PAD_ID = 0
UNK_ID = 1

# Fixed value: the published GPT-2 word pattern, with Unicode character classes.
WORD_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

SPECIAL_PATTERN = "|".join(re.escape(token) for token in SPECIAL_TOKENS)

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def _is_mark(char: str) -> bool:
    return unicodedata.category(char).startswith("M")


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str]:
    """(characters, replacements) for decompose, lower-case and drop marks.

    Derived from the Unicode database. Characters without a replacement are
    deleted. Hangul syllables become several characters and are left out.
    """
    mapped, targets, deleted = [], [], []
    for point in range(0x110000):
        char = chr(point)
        if _HANGUL_FIRST <= point <= _HANGUL_LAST or unicodedata.category(char) in ("Cs", "Cn"):
            continue
        lowered = "".join(part.lower() for part in unicodedata.normalize("NFD", char))
        folded = "".join(part for part in lowered if not _is_mark(part))
        if folded == "":
            deleted.append(char)
        elif folded != char:
            mapped.append(char)
            targets.append(folded)
    return "".join(mapped + deleted), "".join(targets)


def _hangul_to_jamo(col: Column) -> Column:
    """Arithmetic Hangul decomposition, one syllable to two or three letters."""
    leads, vowels, tails = (
        F.lit("".join(map(chr, range(first, first + count))))
        for first, count in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
    )

    def decompose(char: Column) -> Column:
        index = F.ascii(char) - _HANGUL_FIRST
        tail = index % 28
        jamo = F.concat(
            F.substring(leads, F.floor(index / 588).cast("int") + 1, F.lit(1)),
            F.substring(vowels, F.floor(index % 588 / 28).cast("int") + 1, F.lit(1)),
            F.when(tail > 0, F.substring(tails, tail, F.lit(1))).otherwise(""),
        )
        return F.when(char.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), jamo).otherwise(char)

    return F.array_join(F.transform(F.split(col, ""), decompose), "")


def normalize_text(col) -> Column:
    """Canonical decomposition, lower-casing, removal of combining marks.

    Pure ASCII rows need ``lower`` only; other rows take one table look-up per
    character, and rows with Hangul are decomposed arithmetically first.
    """
    text = _col(col)
    mapped, targets = _fold_tables()
    fold = lambda value: F.translate(value, mapped, targets)
    return (
        F.when(F.octet_length(text) == F.length(text), F.lower(text))
        .when(text.rlike(f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"), fold(_hangul_to_jamo(text)))
        .otherwise(fold(text))
    )


def pretokenize(col) -> Column:
    """Split a text into words; a leading space stays with its word."""
    return F.regexp_extract_all(_col(col), F.lit(WORD_PATTERN), F.lit(0))


def words_of(col) -> Column:
    """Normalise, then split: the words that vocabulary training counts."""
    return pretokenize(normalize_text(col))


def words_to_encode(col) -> Column:
    """As ``words_of``, but literal special tokens in the text stay whole."""
    text = _col(col)
    boundary = f"(?={SPECIAL_PATTERN})|(?<={SPECIAL_PATTERN})"
    pieces = F.filter(F.split(text, boundary), lambda piece: piece != "")
    around = F.flatten(
        F.transform(
            pieces,
            lambda piece: F.when(piece.isin(SPECIAL_TOKENS), F.array(piece)).otherwise(words_of(piece)),
        )
    )
    # Plain substring tests: far cheaper than one pattern over every text.
    literal = functools.reduce(operator.or_, [F.contains(text, F.lit(token)) for token in SPECIAL_TOKENS])
    return F.when(literal, around).otherwise(words_of(text))


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> str:
    """Printable stand-in of each byte 0-255, at the byte's position.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 upwards in byte order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(byte if byte in printable else next(spare)) for byte in range(256))


def _moved_bytes() -> tuple[str, str]:
    moved = [(chr(byte), symbol) for byte, symbol in enumerate(byte_alphabet()) if chr(byte) != symbol]
    return "".join(raw for raw, _ in moved), "".join(symbol for _, symbol in moved)


def byte_symbols(col) -> Column:
    """One printable symbol per UTF-8 byte of the text."""
    raw, symbols = _moved_bytes()
    return F.translate(F.decode(F.encode(_col(col), "UTF-8"), "ISO-8859-1"), raw, symbols)


def text_of_symbols(col) -> Column:
    """Inverse of ``byte_symbols``; broken byte sequences become U+FFFD."""
    raw, symbols = _moved_bytes()
    data = F.encode(F.translate(_col(col), symbols, raw), "ISO-8859-1")
    return F.make_valid_utf8(data.cast("string"))
