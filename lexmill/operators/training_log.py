"""Analytics over step and epoch metrics of a training run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.measures import perplexity
from lexmill.operators.batches import numbered

ROLLING_WINDOW = 50
_BLOCK_STEPS = 65_536


def _mean_loss() -> Column:
    tokens = F.sum("num_tokens")
    return F.when(tokens > 0, F.sum(F.col("loss") * F.col("num_tokens")) / tokens).otherwise(
        F.lit(float("inf"))
    )


def weighted_loss(df: DataFrame, *by: str) -> DataFrame:
    """Token-weighted mean loss; without tokens it is infinite."""
    return df.groupBy(*by).agg(
        _mean_loss().alias("loss"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("num_tokens")
    )


def evaluate(losses: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Loss and perplexity of an evaluation from one loss per batch.

    ``losses(batch_id, loss)`` come from any model; ``weights`` are the target
    counts of the batches, see ``target_tokens``. Without them the losses have
    ``num_tokens`` beside them.
    """
    joined = losses if weights is None else losses.join(weights, "batch_id")
    totals = joined.agg(_mean_loss().alias("loss"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("num_tokens"))
    return totals.withColumn("perplexity", perplexity("loss"))


def rolling_loss(df: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """Add the mean over the last ``window`` recorded losses of the same epoch, and its perplexity.

    Rows count, not step numbers: gaps do not shorten the window, and a repeated
    step is a record of its own (in the order of its loss). An epoch is cut into
    blocks of positions, and the last rows of a block are also sent to the next
    one as context, so no task has to hold a whole epoch.
    """
    size = max(_BLOCK_STEPS, window)
    placed = numbered(df, ["epoch", "step", "loss"], "_position")
    block = F.floor(F.col("_position") / size)
    tail = F.col("_position") % size > size - window
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    frame = W.partitionBy("epoch", "_block").orderBy("_position").rowsBetween(-(window - 1), 0)
    return (
        placed.withColumn("_block", F.explode(copies))
        .withColumn("rolling_loss", F.avg("loss").over(frame))
        .filter(F.col("_block") == block)
        .withColumn("rolling_perplexity", perplexity("rolling_loss"))
        .drop("_block", "_position")
    )


def global_step(df: DataFrame, steps_per_epoch: int | Column) -> DataFrame:
    steps = F.lit(steps_per_epoch) if isinstance(steps_per_epoch, int) else steps_per_epoch
    return df.withColumn("global_step", F.col("epoch") * steps + F.col("step"))


def best_so_far(epochs: DataFrame) -> DataFrame:
    """Flag epochs whose validation loss is below that of all earlier ones.

    The table has one row per epoch, which bounds the single ordered window.
    """
    earlier = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    best = F.coalesce(F.min("val_loss").over(earlier), F.lit(float("inf")))
    return epochs.withColumn("is_best", F.col("val_loss") < best)


def epoch_summary(steps: DataFrame, evals: DataFrame) -> DataFrame:
    """Train and validation results and seconds per epoch.

    ``steps(epoch, loss, num_tokens)`` and ``evals(epoch, val_loss,
    epoch_seconds, val_seconds)``; steps are summed before the join.
    """
    train = weighted_loss(steps, "epoch").select("epoch", F.col("loss").alias("train_loss"))
    return train.join(evals, "epoch").select(
        "epoch",
        "train_loss",
        perplexity("train_loss").alias("train_perplexity"),
        "val_loss",
        perplexity("val_loss").alias("val_perplexity"),
        "epoch_seconds",
        (F.col("epoch_seconds") - F.col("val_seconds")).alias("train_seconds"),
        "val_seconds",
    )


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The row with the lowest validation loss, the earliest on ties; an epoch without one is never better."""
    return epochs.orderBy(F.asc_nulls_last("val_loss"), "epoch").limit(1)


def loss_curves(epochs: DataFrame) -> DataFrame:
    """Train and validation curves in long form: ``chart, series, epoch, value``."""
    points = [
        F.struct(F.lit(chart).alias("chart"), F.lit(series).alias("series"), value.alias("value"))
        for chart, measure in (("loss", F.col), ("perplexity", perplexity))
        for series, value in (("train", measure("train_loss")), ("val", measure("val_loss")))
    ]
    return epochs.select("epoch", F.explode(F.array(*points)).alias("point")).select(
        "point.chart", "point.series", "epoch", "point.value"
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts of a numeric or numeric-array column: ``kind, bin, low, high, cnt``.

    The range comes from the finite values, in one narrow pass as a scalar
    subquery; counting is combined within tasks. The maximum belongs to the last
    bin. NaN and the infinities are counted by themselves, by ``kind``.
    """

    def bounds(value: Column) -> Column:
        number = value.cast("double")
        return F.when(F.abs(number) < float("inf"), number)

    is_array = df.schema[column].dataType.typeName() == "array"
    if is_array:
        finite = F.filter(F.transform(column, bounds), lambda value: value.isNotNull())
        smallest, largest = F.array_min(finite), F.array_max(finite)
    else:
        smallest = largest = bounds(F.col(column))
    low = df.agg(F.min(smallest)).scalar()
    high = df.agg(F.max(largest)).scalar()
    values = df.select((F.explode(column) if is_array else F.col(column)).alias("value"))
    values = values.select(F.col("value").cast("double")).filter(F.col("value").isNotNull())
    value = F.col("value")
    kind = (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise("finite")
    )
    placed = values.select(
        kind.alias("kind"),
        F.when(
            kind == "finite",
            F.least(F.greatest(F.width_bucket(value, low, high, F.lit(bins)), F.lit(1)), F.lit(bins)),
        ).alias("bin"),
    )
    counted = placed.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    step = (high - low) / bins
    return counted.select(
        "kind", "bin", (low + (F.col("bin") - 1) * step).alias("low"), (low + F.col("bin") * step).alias("high"), "cnt"
    )
