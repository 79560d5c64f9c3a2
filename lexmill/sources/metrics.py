"""Training logs as tables."""

from pyspark.sql import DataFrame, SparkSession

STEP_SCHEMA = (
    "epoch int, step int, loss double, num_tokens bigint, lr double, step_seconds double"
)
EPOCH_SCHEMA = (
    "epoch int, train_loss double, val_loss double, epoch_seconds double, val_seconds double"
)


def read_metrics(spark: SparkSession, path: str, schema: str = STEP_SCHEMA, file_format: str = "parquet") -> DataFrame:
    """Step or epoch metrics with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).format(file_format).load(path)
