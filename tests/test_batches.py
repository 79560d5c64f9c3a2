import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.sequences import pad_min
from lexmill.operators import batches, corpus


def sequences(spark, rows):
    return spark.createDataFrame(rows, "key bigint, tokens array<int>")


def collated(spark, rows, size=8):
    assigned = batches.assign_batches(sequences(spark, rows), "key", size)
    return {row["batch_id"]: row["rows"] for row in batches.collate(assigned).collect()}


def test_collate_golden(spark):
    assert collated(spark, [(1, [1, 2, 3]), (2, [4, 5]), (3, [6])]) == {0: [[1, 2, 3], [4, 5, 0]]}
    assert collated(spark, [(1, [6])]) == {0: [[0, 0]]}
    assert collated(spark, [(1, []), (2, [1]), (3, [7, 8, 9])], size=2) == {0: [[0, 0]], 1: [[7, 8, 9]]}


def test_filter_pad_shift_golden(spark):
    df = sequences(spark, [(1, []), (2, [5]), (3, [5, 6]), (4, [1, 2, 3])])
    assert [row["key"] for row in batches.filter_short(df).orderBy("key").collect()] == [3, 4]
    assert batches.short_counts(df).collect()[0].asDict() == {"kept": 2, "dropped": 2}
    padded = df.orderBy("key").select(pad_min("tokens", 2).alias("tokens")).collect()
    assert [row["tokens"] for row in padded] == [[0, 0], [5, 0], [5, 6], [1, 2, 3]]
    pairs = batches.shift_pairs(df).orderBy("key").collect()
    assert [(row["input_ids"], row["target_ids"]) for row in pairs] == [([5], [6]), ([1, 2], [2, 3])]


def test_positions_with_a_frequent_leading_value(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 50)}", i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, i int").repartition(13)
    got = {(row["name"], row["i"]): row["position"] for row in batches.numbered(df, ["name", "i"]).collect()}
    assert got == {row: position for position, row in enumerate(sorted(rows))}


def test_rows_without_a_key_are_kept(spark):
    df = sequences(spark, [(None, [9, 9]), (5, [1, 2]), (3, [3, 4])])
    rows = batches.assign_batches(df, "key", 2).orderBy("batch_id", "pos").collect()
    assert [(row["key"], row["batch_id"], row["pos"]) for row in rows] == [(None, 0, 0), (3, 0, 1), (5, 1, 0)]


def test_order_columns_must_identify_a_row(spark):
    with pytest.raises(ValueError):
        batches.assign_batches(sequences(spark, [(1, [1]), (1, [2])]), "key")


def test_shuffling_depends_on_epoch_and_seed_only(spark):
    df = sequences(spark, [(i, [i, i]) for i in range(100)])

    def order(frame, epoch, seed=0):
        rows = batches.shuffle_rows(frame, "key", epoch, seed).orderBy("batch_id", "pos").collect()
        return [row["key"] for row in rows]

    first = order(df, 0)
    assert first == order(df.repartition(7), 0)
    assert sorted(first) == list(range(100))
    assert first != order(df, 1) and first != order(df, 0, seed=1)


def test_target_tokens_with_and_without_padding(spark):
    assigned = batches.assign_batches(sequences(spark, [(1, [1, 2, 3]), (2, [4, 5])]), "key")
    collated_batches = batches.collate(assigned)
    weight = batches.target_tokens(collated_batches).collect()[0]
    assert (weight["num_tokens"], weight["real_tokens"]) == (4, 3)


def test_preview_pads_to_its_batch(spark):
    df = sequences(spark, [(i, list(range(1, i + 2))) for i in range(1, 30)])
    rows = batches.preview(df, "key", rows=2, width=4).orderBy("pos").collect()
    assert [row["tokens"] for row in rows] == [[1, 2, 0, 0], [1, 2, 3, 0]]


def test_truncate_golden(spark):
    rows = corpus.truncate_tokens(sequences(spark, [(1, [7] * 513), (2, [7] * 512)])).orderBy("key").collect()
    assert [(len(row["tokens"]), row["token_count"], row["truncated"]) for row in rows] == [
        (512, 513, True),
        (512, 512, False),
    ]


def test_split_is_whole_stable_and_sends_empty_rows_to_val(spark):
    df = sequences(spark, [(i, [1] if i % 10 else []) for i in range(5000)])
    split = corpus.split_corpus(df, "key")
    first = {row["key"]: row["split"] for row in split.collect()}
    assert first == {row["key"]: row["split"] for row in corpus.split_corpus(df.repartition(11), "key").collect()}
    assert len(first) == 5000
    assert all(first[i] == "val" for i in range(0, 5000, 10))
    train = sum(value == "train" for value in first.values())
    assert abs(train / 4500 - 0.8) < 0.03
    shares = {row["split"]: row["samples"] for row in corpus.split_shares(split).collect()}
    assert shares == {"train": train, "val": 5000 - train}


def test_statistics_without_rows(spark):
    empty = corpus.truncate_tokens(sequences(spark, []))
    row = corpus.corpus_stats(empty).collect()[0]
    assert (row["articles"], row["total_tokens"], row["mean_tokens"], row["min_tokens"]) == (0, 0, None, None)
    shares = corpus.split_shares(corpus.split_corpus(empty, "key")).collect()
    assert [(row["split"], row["samples"], row["pct"]) for row in shares] == [("train", 0, None), ("val", 0, None)]


def test_collate_needs_no_single_task(spark):
    df = spark.range(100_000).select(F.col("id").alias("key"), F.array(F.lit(1), F.lit(2)).alias("tokens"))
    result = batches.collate(batches.assign_batches(df, "key"))
    sizes = result.select(F.size("rows").alias("n")).groupBy("n").count().collect()
    assert [(row["n"], row["count"]) for row in sizes] == [(8, 12_500)]
    plan = batches.assign_batches(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Broadcast")[0]


def test_rows_are_made_once_to_be_numbered(spark):
    """Sampling the ranges is a pass of its own; what made the rows, such as encoding, is not done again for it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(value):
        made.add(1)
        return value

    df = spark.range(500).select("id", counted.asNondeterministic()(F.col("id").cast("int")).alias("made"))
    rows = batches.numbered(df, ["id"]).collect()
    assert made.value == 500
    assert [row["position"] for row in sorted(rows, key=lambda row: row["id"])] == list(range(500))
    level = df.storageLevel
    assert not level.useMemory and not level.useDisk


def test_numbering_leaves_a_cache_of_the_caller(spark):
    df = spark.range(20).withColumn("x", F.lit(1)).persist()
    assert batches.numbered(df, ["id"]).count() == 20
    assert df.storageLevel.useMemory
    df.unpersist()
