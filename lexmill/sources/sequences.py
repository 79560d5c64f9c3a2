"""Token sequences and their train/validation split on disk."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """Write one Parquet folder per split; a reader of one split skips the other."""
    df.write.partitionBy("split").parquet(path)


def read_sequences(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sequences written by ``write_splits`` or any Parquet table with ``tokens``.

    ``part`` and ``row``, the file and the position in it, identify a sequence
    and give the stored order.
    """
    df = spark.read.parquet(path).withColumns(
        {
            "tokens": F.col("tokens").cast("array<int>"),
            "part": F.col("_metadata.file_name"),
            "row": F.col("_metadata.row_index"),
        }
    )
    return df if split is None else df.filter(F.col("split") == split)


def read_sequence_json(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of files that are one JSON array of id arrays, of any size.

    Every ``]`` ends one sequence, so the text source splits a file there.
    ``part``, ``block`` and ``row`` identify a sequence and give its order. Text
    that is no id array, or a file without its last bracket, is an error.
    """
    chunks = spark.read.option("lineSep", "]").text(path)
    ends = chunks.filter(F.col("value").rlike(r"^\s*\[?\s*$")).select("_metadata.file_path").distinct()
    if ends.count() < spark.read.format("binaryFile").load(path).select("path").count():
        raise ValueError(f"a file of {path} is not a closed array")
    value = F.regexp_replace("value", r"\s", "")
    # A single bracket is the start of an empty file; a blank is what follows the last sequence.
    sequence = F.when(value.rlike(r"^(\[|,)\[[\d,]*$"), F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)))
    failed = F.raise_error(F.concat(F.lit("not an array of ids: "), F.left(value, F.lit(80)))).cast("array<string>")
    return chunks.filter(~value.isin("", "[")).select(
        F.coalesce(sequence, failed).cast("array<int>").alias("tokens"),
        F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
