"""Scalar measures used on training logs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col


def perplexity(col) -> Column:
    return F.exp(_col(col))


def hms(col) -> Column:
    """Seconds as a struct of whole hours, minutes and seconds."""
    seconds = F.floor(_col(col)).cast("bigint")
    return F.struct(
        F.floor(seconds / 3600).alias("hours"),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60).alias("minutes"),
        F.pmod(seconds, F.lit(60)).alias("seconds"),
    )


def remaining_seconds(elapsed, done, total) -> Column:
    """Time left if the remaining items take as long as those done so far.

    One item is too few to estimate a total: nothing is left to show then.
    """
    elapsed, done, total = _col(elapsed), _col(done), _col(total)
    return F.when(done > 1, elapsed / done * total - elapsed).otherwise(F.lit(0.0))
