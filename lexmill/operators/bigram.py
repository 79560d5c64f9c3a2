"""A next-token model of counts: fitted on training sequences, used to score others.

The probability of a token after another is ``(count + 1) / (context + vocabulary)``:
add-one smoothing, so that a pair that never occurred has a finite loss too.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.measures import perplexity
from lexmill.functions.sequences import inputs_of, targets_of, without_padding
from lexmill.operators.training_log import weighted_loss
from lexmill.session import materialize

#: Contexts are at most the vocabulary; up to this number they are broadcast, beyond it joined.
MAX_BROADCAST_CONTEXTS = 1_000_000


@dataclass(frozen=True)
class BigramModel:
    """``pairs(prev, next, cnt)``, ``contexts(prev, total)`` and the number of tokens that can follow."""

    pairs: DataFrame
    contexts: DataFrame
    vocab_size: int


def next_token_pairs(df: DataFrame, *keys: str, tokens: str = "tokens", include_padding: bool = False) -> DataFrame:
    """A row ``prev, next`` for each two neighbours of a sequence, beside its keys.

    Without padding, the ids that fill a sequence up are left out. A sequence
    without neighbours has one row of nulls, so that its keys are not lost.
    """
    given = F.col(tokens) if include_padding else without_padding(tokens)
    shifted = df.select(*keys, given.alias("_given")).select(
        *keys, F.arrays_zip(inputs_of("_given").alias("prev"), targets_of("_given").alias("next")).alias("_pairs")
    )
    return shifted.select(*keys, F.explode_outer("_pairs").alias("_pair")).select(*keys, "_pair.prev", "_pair.next")


def fit_bigram(df: DataFrame, vocab_size: int, tokens: str = "tokens", include_padding: bool = False) -> BigramModel:
    """Count pairs of neighbours; the counts of contexts are sums of theirs.

    The only shuffle of the corpus is that of pair counts which tasks have added
    up before. It goes by both tokens, so a context that most pairs share is
    spread over all tasks.
    """
    found = next_token_pairs(df, tokens=tokens, include_padding=include_padding).filter("prev is not null")
    pairs = materialize(found.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("cnt")))
    contexts = pairs.groupBy("prev").agg(F.sum("cnt").alias("total"))
    return BigramModel(pairs, contexts, vocab_size)


def smoothed(cnt: Column, total: Column, vocab_size: int) -> Column:
    """The probability of a pair; what was never counted is null."""
    zero = F.lit(0)
    return (F.coalesce(cnt, zero) + 1) / (F.coalesce(total, zero) + vocab_size)


def pair_probabilities(model: BigramModel) -> DataFrame:
    """The counted pairs with their context's total and their probability."""
    joined = _with_contexts(model.pairs, model)
    return joined.withColumn("p", smoothed(F.col("cnt"), F.col("total"), model.vocab_size))


def _with_contexts(df: DataFrame, model: BigramModel) -> DataFrame:
    contexts = model.contexts
    if contexts.count() <= MAX_BROADCAST_CONTEXTS:
        contexts = F.broadcast(contexts)
    return df.join(contexts, "prev", "left")


def score_bigram(
    df: DataFrame, model: BigramModel, *keys: str, tokens: str = "tokens", include_padding: bool = False
) -> DataFrame:
    """Cross-entropy of every sequence, or of all sequences of a key: the keys, ``loss, num_tokens, perplexity``.

    Each pair looks up its count, one that never occurred only its context. The
    look-up joins by both tokens; a pair that is very frequent is split by Spark's
    skew join. A sequence without neighbours has no tokens and an infinite loss.
    """
    pairs = next_token_pairs(df, *keys, tokens=tokens, include_padding=include_padding)
    counted = _with_contexts(pairs.join(model.pairs, ["prev", "next"], "left"), model)
    loss = -F.log(smoothed(F.col("cnt"), F.col("total"), model.vocab_size))
    is_pair = F.col("prev").isNotNull()
    weighed = counted.select(
        *keys, F.when(is_pair, loss).alias("loss"), F.when(is_pair, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("num_tokens")
    )
    return weighted_loss(weighed, *keys).withColumn("perplexity", perplexity("loss"))
