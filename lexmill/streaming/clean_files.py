"""Cleaning the files that arrived since the last run."""

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators.corpus import clean_articles
from lexmill.sources.articles import accepted, jsonl_records


def clean_new_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Clean every JSON-lines file not cleaned before, then return.

    The file stream remembers finished files in ``checkpoint``, so a run that was
    cut short goes on where it stopped. A file is never split between batches,
    which keeps the rejection of whole files exact; each batch has a folder of
    its own, so repeating a batch replaces it.
    """

    def clean(lines: DataFrame, batch: int) -> None:
        articles = clean_articles(accepted(jsonl_records(lines, source)))
        articles.write.mode("overwrite").partitionBy("folder").parquet(f"{target}/batch={batch}")

    lines = spark.readStream.option("recursiveFileLookup", True).text(source)
    stream = (
        lines.select("value", "_metadata.file_path")
        .writeStream.foreachBatch(clean)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
