"""Expressions over token sequences (array columns)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col
from lexmill.functions.tokens import PAD_ID


def clip(col, max_length: int) -> Column:
    """The first ``max_length`` tokens."""
    return F.slice(_col(col), 1, max_length)


def pad_to(col, width) -> Column:
    """Right-pad with the padding id up to ``width``; longer rows stay as they are."""
    tokens = _col(col)
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(tokens, F.array_repeat(F.lit(PAD_ID), F.greatest(width - F.size(tokens), F.lit(0))))


def pad_min(col, k: int) -> Column:
    return pad_to(col, k)


def inputs_of(col) -> Column:
    """All tokens but the last."""
    tokens = _col(col)
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def targets_of(col) -> Column:
    """All tokens but the first."""
    tokens = _col(col)
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def without_padding(col) -> Column:
    """The tokens up to the last one that is not the padding id."""
    tokens = _col(col)
    # The position from behind of the first real token is where the padding ends.
    real = F.array_position(F.transform(F.reverse(tokens), lambda token: token != PAD_ID), True)
    return F.slice(tokens, F.lit(1), F.when(real > 0, F.size(tokens) - real.cast("int") + 1).otherwise(F.lit(0)))


def chunks(col, length: int) -> Column:
    """All tokens in pieces of ``length``, the last one shorter; no piece of an empty sequence."""
    tokens = _col(col)
    count = F.ceil(F.size(tokens) / length).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda number: F.slice(tokens, number * length + 1, F.lit(length)))
