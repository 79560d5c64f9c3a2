"""Bounded samples of labelled rows for fitting models; everything fitted is later applied to all rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_ids(df: DataFrame, key: str, label: str, classes: Sequence, per_class: int) -> list[tuple]:
    """Up to ``per_class`` keys of each class with their labels, drawn by the hash of the key, so the same rows each time.

    Only the key and the label are read. What reaches the driver is at most
    ``len(classes) * per_class`` rows.
    """
    found = []
    for value in classes:
        rows = df.where((F.col(label) == F.lit(value)) & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(per_class).collect()
        found += [(row["k"], value) for row in rows]
    return found


def sample_frame(df: DataFrame, found: list[tuple], key: str) -> DataFrame:
    """The rows of the sampled keys with the column ``sample_label``. The sample is broadcast: its size is bounded above."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    labels = "string" if found and isinstance(found[0][1], str) else "int"
    sample = spark.createDataFrame([(k, v) for k, v in found], f"sample_key {kind}, sample_label {labels}")
    return df.join(F.broadcast(sample), F.col(key) == F.col("sample_key")).drop("sample_key")
