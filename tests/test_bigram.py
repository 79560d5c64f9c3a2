"""The next-token model and the fixed-length pieces."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import batches, bigram, corpus

VOCAB = 50


def sequences(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, tokens array<int>")


def plain_loss(train, row):
    """Mean loss of a sequence, pair by pair."""
    pairs = Counter(pair for tokens in train for pair in zip(tokens, tokens[1:]))
    contexts = Counter(prev for tokens in train for prev in tokens[:-1])
    losses = [-math.log((pairs[pair] + 1) / (contexts[pair[0]] + VOCAB)) for pair in zip(row, row[1:])]
    return sum(losses) / len(losses) if losses else math.inf


TRAIN = [[7, 8, 9, 7, 8], [7, 7, 7], [9], [], [8, 9, 10]]


def test_fit_counts_pairs_and_contexts(spark):
    found = bigram.pair_probabilities(bigram.fit_bigram(sequences(spark, TRAIN), VOCAB)).collect()
    assert {(row["prev"], row["next"]): (row["cnt"], row["total"], row["p"]) for row in found} == {
        (7, 8): (2, 4, 3 / 54), (7, 7): (2, 4, 3 / 54), (8, 9): (2, 2, 3 / 52), (9, 7): (1, 2, 2 / 52), (9, 10): (1, 2, 2 / 52)
    }


def test_probabilities_of_a_context_sum_to_one(spark):
    model = bigram.fit_bigram(sequences(spark, TRAIN), VOCAB)
    for row in bigram.pair_probabilities(model).groupBy("prev").agg(F.sum("p").alias("p"), F.count("*").alias("n"), F.first("total").alias("t")).collect():
        assert row["p"] + (VOCAB - row["n"]) / (row["t"] + VOCAB) == pytest.approx(1)


@pytest.mark.parametrize("limit", [bigram.MAX_BROADCAST_CONTEXTS, 0])
def test_scores_seen_unseen_and_empty(spark, monkeypatch, limit):
    """Known pairs, unknown pairs of a known context, unknown contexts, and sequences without pairs; contexts broadcast or joined."""
    monkeypatch.setattr(bigram, "MAX_BROADCAST_CONTEXTS", limit)
    rows = [[7, 8, 9], [7, 10], [40, 41], [7], [], [10, 7, 8, 8]]
    model = bigram.fit_bigram(sequences(spark, TRAIN), VOCAB)
    found = {row["doc_id"]: row for row in bigram.score_bigram(sequences(spark, rows), model, "doc_id").collect()}
    for at, row in enumerate(rows):
        assert found[at]["num_tokens"] == max(len(row) - 1, 0)
        assert found[at]["loss"] == pytest.approx(plain_loss(TRAIN, row))
        assert found[at]["perplexity"] == pytest.approx(math.exp(plain_loss(TRAIN, row)))


def test_padding_counts_only_on_demand(spark):
    rows = sequences(spark, [[7, 8, 0, 0], [7, 0, 8, 0], [0, 0]])
    model = bigram.fit_bigram(sequences(spark, TRAIN), VOCAB)
    with_padding = bigram.score_bigram(rows, model, "doc_id", include_padding=True).collect()
    without = bigram.score_bigram(rows, model, "doc_id").collect()
    assert {row["doc_id"]: row["num_tokens"] for row in with_padding} == {0: 3, 1: 3, 2: 1}
    # An id 0 between others is no padding.
    assert {row["doc_id"]: row["num_tokens"] for row in without} == {0: 1, 1: 2, 2: 0}
    assert {row["doc_id"]: row["loss"] for row in without}[1] == pytest.approx(plain_loss(TRAIN, [7, 0, 8]))


def test_a_context_of_most_pairs_is_spread(spark):
    """Nine of ten pairs follow one token; no partition of the counts gets more than a fair share of them."""
    rows = [[7, 100 + i % 997] * 9 + [20 + i % 3, 21] for i in range(3000)]
    model = bigram.fit_bigram(sequences(spark, rows), 32_000)
    counted = Counter(pair for tokens in rows for pair in zip(tokens, tokens[1:]))
    assert {(row["prev"], row["next"]): row["cnt"] for row in model.pairs.collect()} == counted
    hot = spark.createDataFrame([(list(pair),) for pair in counted if pair[0] == 7], "tokens array<int>")
    parts = hot.select(F.col("tokens")[0].alias("prev"), F.col("tokens")[1].alias("next")).repartition(8, "prev", "next")
    shares = [row["n"] for row in parts.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert len(shares) == 8 and max(shares) < 2 * 997 / 8
    total = model.contexts.filter("prev = 7").first()["total"]
    assert total == sum(count for (prev, _), count in counted.items() if prev == 7) > 0.45 * sum(counted.values())
    scored = bigram.score_bigram(sequences(spark, rows), model, "doc_id").agg(F.sum("num_tokens")).first()[0]
    assert scored == sum(counted.values())


def test_losses_feed_the_evaluation(spark):
    """The weighted mean of batch losses is the loss over all pairs."""
    rows = sequences(spark, [[7, 8, 9], [9, 7], [8, 8, 8, 8], [10, 7]])
    model = bigram.fit_bigram(sequences(spark, TRAIN), VOCAB)
    collated = batches.collate(batches.assign_batches(rows, "doc_id", size=2))
    padded = batches.batch_rows(collated)
    by_batch = bigram.score_bigram(padded, model, "batch_id", include_padding=True)
    whole = bigram.score_bigram(padded, model, include_padding=True).first()
    from lexmill.operators.training_log import evaluate

    found = evaluate(by_batch.select("batch_id", "loss"), batches.target_tokens(collated)).first()
    assert found["loss"] == pytest.approx(whole["loss"]) and found["num_tokens"] == whole["num_tokens"] == 10


def test_chunks_lose_no_id(spark):
    lengths = [0, 1, 4, 5, 6, 10, 11]
    rows = [list(range(7, 7 + n)) for n in lengths]
    cut = corpus.chunk_tokens(sequences(spark, rows).withColumn("chunk", F.lit("clash")), max_length=5)
    found = sorted((row["doc_id"], row["chunk"], row["token_count"], row["tokens"]) for row in cut.collect())
    wanted = []
    for at, row in enumerate(rows):
        pieces = [row[i : i + 5] for i in range(0, len(row), 5)] or [[]]
        wanted += [(at, i, len(piece), piece) for i, piece in enumerate(pieces)]
    assert found == wanted


def test_chunks_are_not_shuffled(spark):
    plan = corpus.chunk_tokens(sequences(spark, [[1, 2]]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
