import math

from pyspark.sql import functions as F

from lexmill.functions.measures import hms, remaining_seconds
from lexmill.operators import training_log as log


def test_rolling_loss_golden(spark):
    steps = spark.range(60).select(F.lit(0).alias("epoch"), F.col("id").alias("step"), F.col("id").cast("double").alias("loss"))
    last = log.rolling_loss(steps).filter("step = 59").collect()[0]
    assert last["rolling_loss"] == 34.5


def test_rolling_loss_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(log, "_BLOCK_STEPS", 10)
    steps = [(epoch, step, float((step * 7 + epoch) % 11)) for epoch in range(2) for step in range(137)]
    df = spark.createDataFrame(steps, "epoch int, step int, loss double")
    got = {(row["epoch"], row["step"]): row["rolling_loss"] for row in log.rolling_loss(df, window=6).collect()}
    losses = {(epoch, step): loss for epoch, step, loss in steps}
    assert len(got) == len(steps)
    for (epoch, step), mean in got.items():
        window = [losses[epoch, i] for i in range(max(step - 5, 0), step + 1)]
        assert math.isclose(mean, sum(window) / len(window))


def test_best_so_far_golden(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0), (3, 1.0)], "epoch int, val_loss double")
    flagged = log.best_so_far(df).orderBy("epoch").collect()
    assert [row["is_best"] for row in flagged] == [True, True, False, True]
    assert log.best_epoch(df.filter("epoch < 3")).collect()[0]["epoch"] == 1


def test_loss_without_tokens_is_infinite(spark):
    df = spark.createDataFrame([], "loss double, num_tokens bigint")
    row = log.weighted_loss(df).collect()[0]
    assert math.isinf(row["loss"]) and row["num_tokens"] == 0


def test_evaluate_weights_batches_by_targets(spark):
    losses = spark.createDataFrame([(0, 1.0), (1, 3.0)], "batch_id bigint, loss double")
    weights = spark.createDataFrame([(0, 30), (1, 10)], "batch_id bigint, num_tokens bigint")
    row = log.evaluate(losses, weights).collect()[0]
    assert row["loss"] == 1.5 and math.isclose(row["perplexity"], math.exp(1.5)) and row["num_tokens"] == 40


def test_durations(spark):
    row = spark.range(1).select(hms(F.lit(7384.9)).alias("t")).collect()[0]["t"]
    assert (row["hours"], row["minutes"], row["seconds"]) == (2, 3, 4)
    left = spark.range(1).select(
        remaining_seconds(F.lit(10.0), F.lit(2), F.lit(8)), remaining_seconds(F.lit(10.0), F.lit(1), F.lit(8))
    )
    assert tuple(left.collect()[0]) == (30.0, 0.0)


def test_rolling_loss_counts_records(spark):
    """Gaps do not shorten the window; a repeated step is a record."""
    steps = [(0, 0, 1.0), (0, 100, 3.0), (0, 200, 5.0), (0, 200, 7.0)]
    rows = log.rolling_loss(spark.createDataFrame(steps, "epoch int, step int, loss double"), window=3).orderBy("step", "loss")
    assert [row["rolling_loss"] for row in rows.collect()] == [1.0, 2.0, 3.0, 5.0]


def test_best_epoch_has_a_loss(spark):
    epochs = spark.createDataFrame([(0, None), (1, 2.0)], "epoch int, val_loss double")
    assert log.best_epoch(epochs).collect()[0]["epoch"] == 1


def test_histogram_counts_odd_values_apart(spark):
    values = [1.0, 2.0, float("nan"), float("inf"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(value,) for value in values], "x double")
    rows = {(row["kind"], row["bin"]): (row["low"], row["high"], row["cnt"]) for row in log.histogram(df, "x", 2).collect()}
    assert rows.pop(("finite", 1)) == (1.0, 1.5, 1) and rows.pop(("finite", 2)) == (1.5, 2.0, 1)
    assert {kind: row[2] for (kind, _), row in rows.items()} == {"nan": 1, "inf": 2, "-inf": 1}


def test_histogram_of_one_value_and_of_integers(spark):
    same = log.histogram(spark.range(5).select(F.lit(2.0).alias("x")), "x", 4).collect()
    assert [(row["bin"], row["cnt"]) for row in same] == [(1, 5)]
    counts = {row["bin"]: row["cnt"] for row in log.histogram(spark.range(101), "id", 4).collect()}
    assert counts == {1: 25, 2: 25, 3: 25, 4: 26}


def test_loss_curves_are_long(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "epoch int, train_loss double, val_loss double")
    rows = {(row["chart"], row["series"]): row["value"] for row in log.loss_curves(df).collect()}
    assert rows[("loss", "train")] == 1.0 and math.isclose(rows[("perplexity", "val")], math.exp(2.0))
