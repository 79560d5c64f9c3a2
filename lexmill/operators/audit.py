"""Article counts per file and folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_counts(df: DataFrame, file: str = "file", folder: str = "folder") -> DataFrame:
    """Articles per file of an article table: ``file, folder, n_articles, error``."""
    return df.groupBy(F.col(file).alias("file"), F.col(folder).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_articles"), F.lit(None).cast("string").alias("error")
    )


def audit_totals(counts: DataFrame) -> DataFrame:
    """Totals over all files. The mean divides by failed files too; without any
    countable file the extremes are NULL."""
    files = F.count(F.lit(1))
    total = F.coalesce(F.sum("n_articles"), F.lit(0))
    return counts.agg(
        total.alias("articles"),
        files.alias("files"),
        F.max("n_articles").alias("max_articles"),
        F.min("n_articles").alias("min_articles"),
        F.when(files > 0, total / files).otherwise(F.lit(0.0)).alias("mean_articles"),
    )


def folder_rollup(counts: DataFrame) -> DataFrame:
    """Articles and countable files per folder."""
    return (
        counts.filter(F.col("n_articles").isNotNull())
        .groupBy("folder")
        .agg(F.sum("n_articles").alias("articles"), F.count(F.lit(1)).alias("files"))
    )


def rank_files(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Files by article count, largest first; failed files rank as empty ones."""
    ranked = counts.orderBy(F.coalesce("n_articles", F.lit(0)).desc(), "file")
    return ranked if k is None else ranked.limit(k)
