"""Ordered batches of token sequences."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.sequences import clip, inputs_of, pad_to, targets_of
from lexmill.functions.tokens import PAD_ID
from lexmill.session import materialize

BATCH_SIZE = 8
MIN_LENGTH = 2

# monotonically_increasing_id keeps the row number of a partition in its low bits.
_ROW_BITS = 33


def filter_short(
    df: DataFrame, min_length: int = MIN_LENGTH, tokens: str = "tokens", count: str | None = None
) -> DataFrame:
    """Keep sequences of at least ``min_length`` tokens.

    With the name of a stored ``count`` column the filter reaches the scan, and a
    query that needs no tokens does not read them.
    """
    return df.filter((F.col(count) if count else F.size(tokens)) >= min_length)


def short_counts(df: DataFrame, min_length: int = MIN_LENGTH, tokens: str = "tokens") -> DataFrame:
    """How many sequences ``filter_short`` keeps and drops."""
    kept = F.count_if(F.size(tokens) >= min_length)
    return df.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped"))


def numbered(df: DataFrame, order: list[str], name: str = "position", unique: bool = False) -> DataFrame:
    """Add the 0-based global position of every row, without a one-task window.

    The rows are range-partitioned and sorted once, with all their columns; Spark
    samples the ranges, so a frequent leading value is split by the columns after
    it. They are checkpointed, which fixes the row numbers; each partition then
    adds the row count of those before it, a table of one row per partition.
    With ``unique`` the order columns must identify a row: equal keys are
    neighbours in the sorted partition, so that check needs no shuffle either.
    """
    # The ranges are sampled in a pass of its own: rows stay in memory or on disk for the second one, which moves them.
    level = df.storageLevel
    held = None if level.useMemory or level.useDisk else df.persist()
    ranged = df.repartitionByRange(*order)
    if unique:
        ranged = ranged.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(*order)))
    sorted_rows = materialize(
        ranged.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    if held is not None:
        held.unpersist()
    if unique:
        if not sorted_rows.filter("_same > 1").isEmpty():
            raise ValueError(f"several rows have the same {', '.join(order)}")
        sorted_rows = sorted_rows.drop("_same")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_row", "_offset")
    )


def assign_batches(df: DataFrame, order: str | list[str], size: int = BATCH_SIZE) -> DataFrame:
    """Add ``batch_id`` and ``pos`` in batch; batches follow the order columns.

    The order columns must identify a row, as ``part`` and ``row`` of stored
    sequences do. The last batch may be short.
    """
    order = [order] if isinstance(order, str) else order
    return (
        numbered(df, order, "_position", unique=True)
        .withColumn("batch_id", F.expr(f"_position div {int(size)}"))
        .withColumn("pos", (F.col("_position") % size).cast("int"))
        .drop("_position")
    )


def shuffle_rows(
    df: DataFrame, key: str | list[str], epoch: int, seed: int = 0, size: int = BATCH_SIZE
) -> DataFrame:
    """Batches in an order that is random per epoch and the same on every run."""
    key = [key] if isinstance(key, str) else key
    parts = [F.lit(str(seed)), F.lit(str(epoch)), *[F.col(name).cast("string") for name in key]]
    drawn = df.withColumn("_draw", F.md5(F.concat_ws(":", *parts)))
    return assign_batches(drawn, ["_draw", *key], size).drop("_draw")


def collate(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One rectangle of ids per batch, right-padded to its longest row.

    Rows under two tokens are left out; a batch without any other row becomes
    one row of two padding ids. A batch holds ``size`` rows, so grouping it is
    bounded whatever the number of batches.
    """
    valid = F.when(F.size(tokens) >= MIN_LENGTH, F.struct("pos", F.col(tokens).alias("tokens")))
    grouped = df.groupBy("batch_id").agg(F.collect_list(valid).alias("valid"))
    ordered = F.transform(F.array_sort("valid"), lambda row: row["tokens"])
    width = F.coalesce(F.array_max(F.transform("ordered", F.size)), F.lit(MIN_LENGTH))
    padded = F.when(
        F.size("ordered") == 0, F.array(F.array_repeat(F.lit(PAD_ID), MIN_LENGTH))
    ).otherwise(F.transform("ordered", lambda row: pad_to(row, F.col("width"))))
    return (
        grouped.select("batch_id", ordered.alias("ordered"))
        .withColumn("width", width)
        .select("batch_id", "width", padded.alias("rows"))
    )


def batch_rows(batches: DataFrame) -> DataFrame:
    """One row per padded sequence of a collated batch."""
    return batches.select("batch_id", F.posexplode("rows").alias("pos", "tokens"))


def shift_pairs(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add input and target sequences; rows too short for a pair are skipped."""
    return df.filter(F.size(tokens) >= MIN_LENGTH).withColumns(
        {"input_ids": inputs_of(tokens), "target_ids": targets_of(tokens)}
    )


def target_tokens(batches: DataFrame) -> DataFrame:
    """Target positions per collated batch, the weight of its loss.

    ``num_tokens`` counts width - 1 for every row; ``real_tokens`` only the ids up
    to the last one that is not padding.
    """

    def real(row: Column) -> Column:
        ids = F.transform(row, lambda token, at: F.when(token != PAD_ID, at))
        return F.coalesce(F.array_max(ids), F.lit(0))

    def total(count) -> Column:
        return F.aggregate(F.transform("rows", count), F.lit(0), lambda total, n: total + n).cast("bigint")

    return batches.filter(F.col("width") >= MIN_LENGTH).select(
        "batch_id", total(lambda row: F.size(row) - 1).alias("num_tokens"), total(real).alias("real_tokens")
    )


def dataset_summary(df: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Samples and batches per split."""
    samples = F.count(F.lit(1))
    return df.groupBy("split").agg(
        samples.alias("samples"), F.ceil(samples / size).cast("bigint").alias("batches")
    )


def preview(
    df: DataFrame, order: str | list[str], rows: int = 2, width: int = 20, size: int = BATCH_SIZE
) -> DataFrame:
    """The first ids of the first rows of the first batch.

    Only that batch is fetched: a top-``size`` query instead of batching all rows.
    """
    order = [order] if isinstance(order, str) else order
    first = df.orderBy(*order).limit(size).withColumn("batch_id", F.lit(0).cast("bigint"))
    keyed = first.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col("tokens")))).alias("sorted")
    )
    numbered = keyed.select("batch_id", F.posexplode("sorted").alias("pos", "row")).select(
        "batch_id", "pos", "row.tokens"
    )
    return (
        batch_rows(collate(numbered))
        .filter(F.col("pos") < rows)
        .select("pos", clip("tokens", width).alias("tokens"))
    )
