"""From raw documents to piece ids: stages that each read what the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.stages import STAGES
from lexmill.llm.texts import stored, table

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL can express neither the classifier nor the piece search; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to the Parquet that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
