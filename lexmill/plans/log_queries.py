"""Queries over training logs."""

from pyspark.sql import functions as F

from lexmill.functions.measures import hms, remaining_seconds
from lexmill.operators import training_log as log
from lexmill.plans import inputs
from lexmill.plans.inputs import daily_evals, daily_steps, step_metrics


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def weighted_loss(spark, sf_dir):
    return _rounded(log.weighted_loss(step_metrics(spark, sf_dir), "epoch"), "loss")


def perplexity(spark, sf_dir):
    steps = step_metrics(spark, sf_dir)
    return steps.select("epoch", "step", F.round(log.perplexity("loss"), 6).alias("perplexity"))


def _uneven_steps(spark, sf_dir):
    """The steps with gaps: their numbers grow by 1 to 100."""
    return step_metrics(spark, sf_dir).withColumn("step", F.col("step") * 100 - F.col("step") % 7 * 14)


_UNEVEN_STEPS_SQL = f"SELECT epoch, step * 100 - step % 7 * 14 AS step, loss FROM ({inputs.STEP_METRICS_SQL})"


def rolling_loss(spark, sf_dir):
    # Nine digits: the mean of up to 50 losses of four decimals has no tie there.
    rolled = log.rolling_loss(_uneven_steps(spark, sf_dir))
    return rolled.select(
        "epoch", "step", F.round("rolling_loss", 9).alias("rolling_loss"),
        F.round("rolling_perplexity", 6).alias("rolling_perplexity"),
    )


def global_step(spark, sf_dir):
    steps = step_metrics(spark, sf_dir)
    per_epoch = steps.agg(F.max("step") + 1).scalar()
    return log.global_step(steps, per_epoch).select("epoch", "step", "global_step")


def best_so_far(spark, sf_dir):
    return log.best_so_far(daily_evals(spark, sf_dir)).select("epoch", "is_best")


def _summary(spark, sf_dir):
    train = daily_steps(spark, sf_dir).filter(~F.col("is_val"))
    return log.epoch_summary(train, daily_evals(spark, sf_dir))


_MEASURES = (
    "train_loss",
    "train_perplexity",
    "val_loss",
    "val_perplexity",
    "epoch_seconds",
    "train_seconds",
    "val_seconds",
)


def epoch_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir), *_MEASURES)


def best_epoch(spark, sf_dir):
    return _rounded(log.best_epoch(_summary(spark, sf_dir)), *_MEASURES)


def loss_curves(spark, sf_dir):
    return _rounded(log.loss_curves(_summary(spark, sf_dir)), "value")


def durations(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(
        F.round(F.sum("value"), 3).alias("total"), F.count("*").alias("items")
    )
    left = remaining_seconds("total", "items", F.col("items") * 3)
    return users.select(
        "user_id", hms("total").alias("t"), F.round(left, 3).alias("remaining")
    ).select("user_id", "t.hours", "t.minutes", "t.seconds", "remaining")


_ODD_VALUES = ("nan", "inf", "inf", "-inf")


def histogram(table, column, bins, is_array=False):
    """Histogram of a column with a few values beside it that are no finite numbers."""

    def query(spark, sf_dir):
        odd = F.array(*[F.lit(float(value)) for value in _ODD_VALUES])
        kind = "array<double>" if is_array else "double"
        given = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).cast(kind).alias("value"))
        added = spark.range(1).select((odd if is_array else F.explode(odd)).alias("value"))
        counted = log.histogram(given.unionByName(added), "value", bins)
        return _rounded(counted, "low", "high").withColumn("bin", F.col("bin").cast("bigint"))

    return query


def _histogram_sql(values: str, bins: int) -> str:
    odd = ", ".join(f"('{value}'::DOUBLE)" for value in _ODD_VALUES)
    return (
        f"WITH a AS ({values} UNION ALL SELECT * FROM (VALUES {odd}) AS t(value)),"
        " v AS (SELECT value FROM a WHERE isfinite(value)), r AS (SELECT min(value) AS lo, max(value) AS hi FROM v), b AS (SELECT lo, hi,"
        f" least(floor({bins}::DOUBLE * (value - lo) / (hi - lo))::BIGINT + 1, {bins}) AS bin FROM v, r)"
        f" SELECT 'finite' AS kind, bin, round(lo + (bin - 1) * ((hi - lo) / {bins}), 6) AS low,"
        f" round(lo + bin * ((hi - lo) / {bins}), 6) AS high, count(*) AS cnt FROM b GROUP BY bin, lo, hi"
        " UNION ALL SELECT CASE WHEN isnan(value) THEN 'nan' WHEN value > 0 THEN 'inf' ELSE '-inf' END, NULL, NULL, NULL,"
        " count(*) FROM a WHERE NOT isfinite(value) GROUP BY 1"
    )


QUERIES = {
    "weighted_loss": weighted_loss,
    "perplexity": perplexity,
    "rolling_loss": rolling_loss,
    "global_step": global_step,
    "best_so_far": best_so_far,
    "epoch_summary": epoch_summary,
    "best_epoch": best_epoch,
    "loss_curves": loss_curves,
    "durations": durations,
    "array_histogram": histogram("embeddings", "embedding", 30, is_array=True),
    "value_histogram": histogram("events", "value", 20),
}

_SUMMARY_SQL = (
    "SELECT epoch, round(train_loss, 6) AS train_loss, round(exp(train_loss), 6) AS train_perplexity,"
    " round(val_loss, 6) AS val_loss, round(exp(val_loss), 6) AS val_perplexity,"
    " round(epoch_seconds, 6) AS epoch_seconds, round(epoch_seconds - val_seconds, 6) AS train_seconds,"
    f" round(val_seconds, 6) AS val_seconds FROM ({inputs.DAILY_SUMMARY_SQL})"
)

ORACLES = {
    "weighted_loss": (
        "SELECT epoch, round(sum(loss * num_tokens) / sum(num_tokens), 6) AS loss, sum(num_tokens)::BIGINT AS num_tokens"
        f" FROM ({inputs.STEP_METRICS_SQL}) GROUP BY epoch"
    ),
    "perplexity": f"SELECT epoch, step, round(exp(loss), 6) AS perplexity FROM ({inputs.STEP_METRICS_SQL})",
    "rolling_loss": (
        "SELECT epoch, step, round(mean, 9) AS rolling_loss, round(exp(mean), 6) AS rolling_perplexity FROM"
        " (SELECT epoch, step, avg(loss) OVER (PARTITION BY epoch ORDER BY step, loss ROWS BETWEEN 49 PRECEDING AND"
        f" CURRENT ROW) AS mean FROM ({_UNEVEN_STEPS_SQL}))"
    ),
    "global_step": (
        "SELECT epoch, step, epoch * (SELECT max(step) + 1 FROM (" + inputs.STEP_METRICS_SQL + ")) + step AS global_step"
        f" FROM ({inputs.STEP_METRICS_SQL})"
    ),
    "best_so_far": (
        "SELECT epoch, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND"
        f" 1 PRECEDING), 'infinity'::DOUBLE) AS is_best FROM ({inputs.DAILY_EVALS_SQL})"
    ),
    "epoch_summary": _SUMMARY_SQL,
    "best_epoch": f"SELECT * FROM ({_SUMMARY_SQL}) ORDER BY val_loss, epoch LIMIT 1",
    "loss_curves": " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, '{series}' AS series, epoch, round({value}, 6) AS value"
        f" FROM ({inputs.DAILY_SUMMARY_SQL})"
        for chart, series, value in (
            ("loss", "train", "train_loss"),
            ("loss", "val", "val_loss"),
            ("perplexity", "train", "exp(train_loss)"),
            ("perplexity", "val", "exp(val_loss)"),
        )
    ),
    "durations": (
        "SELECT user_id, s // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds,"
        " round(CASE WHEN items > 1 THEN total / items * (items * 3) - total ELSE 0 END, 3) AS remaining"
        " FROM (SELECT *, floor(total)::BIGINT AS s FROM (SELECT user_id, round(sum(value), 3) AS total,"
        " count(*) AS items FROM events GROUP BY user_id))"
    ),
    "array_histogram": _histogram_sql("SELECT unnest(embedding)::DOUBLE AS value FROM embeddings", 30),
    "value_histogram": _histogram_sql("SELECT value FROM events WHERE value IS NOT NULL", 20),
}
