"""Queries of the next-token model: fitted on the training split, scoring both."""

import functools

from pyspark.sql import functions as F

from lexmill.operators import batches, bigram, bpe, corpus, training_log
from lexmill.plans.inputs import SEQUENCES_SQL, SPLIT_SQL, joined, sequences
from lexmill.plans.token_queries import full_sequences
from lexmill.session import new_shared_path
from lexmill.sources import sequences as stored

_VOCAB_SIZE = bpe.VOCAB_SIZE


def _splits(spark, sf_dir, given):
    """The truncated sequences of both splits, stored as training reads them."""
    path = new_shared_path(spark, "splits")
    stored.write_splits(corpus.split_corpus(corpus.truncate_tokens(given(spark, sf_dir)), "doc_id"), path)
    return stored.read_sequences(spark, path)


def _fitted(built):
    return bigram.fit_bigram(built.filter("split = 'train'"), _VOCAB_SIZE)


def bigram_fit(spark, sf_dir, given=sequences):
    """Counts and smoothed probabilities of all pairs of the training split."""
    fitted = bigram.pair_probabilities(_fitted(_splits(spark, sf_dir, given)))
    return fitted.select(
        F.col("prev").cast("bigint").alias("prev"),
        F.col("next").cast("bigint").alias("next"),
        "cnt",
        "total",
        F.round("p", 9).alias("p"),
    )


def _measured(scored, *keys):
    return scored.select(*keys, F.round("loss", 6).alias("loss"), "num_tokens", F.round("perplexity", 3).alias("perplexity"))


def bigram_loss(spark, sf_dir, given=sequences):
    """Loss and perplexity of every document; those of the training split were fitted on."""
    built = _splits(spark, sf_dir, given)
    return _measured(bigram.score_bigram(built, _fitted(built), "doc_id", "split"), "doc_id", "split")


def bigram_split_loss(spark, sf_dir, given=sequences):
    """Loss and perplexity of both splits, from one pass over their pairs."""
    built = _splits(spark, sf_dir, given)
    return _measured(bigram.score_bigram(built, _fitted(built), "split"), "split")


def _val_batches(built):
    val = batches.filter_short(built.filter("split = 'val'"), count="token_count")
    return batches.collate(batches.assign_batches(val, "doc_id"))


def bigram_batch_loss(spark, sf_dir, given=sequences):
    """Loss of every validation batch, with the padding as targets and without."""
    built = _splits(spark, sf_dir, given)
    model, rows = _fitted(built), batches.batch_rows(_val_batches(built))
    padded = _measured(bigram.score_bigram(rows, model, "batch_id", include_padding=True), "batch_id")
    real = _measured(bigram.score_bigram(rows, model, "batch_id"), "batch_id")
    return padded.withColumn("padding", F.lit(True)).unionByName(real.withColumn("padding", F.lit(False)))


def evaluate(spark, sf_dir, given=sequences):
    """Loss and perplexity of the collated validation batches, whose losses the fitted model gives.

    As in training, every target position of a batch counts, padding too.
    """
    built = _splits(spark, sf_dir, given)
    collated = _val_batches(built)
    losses = bigram.score_bigram(batches.batch_rows(collated), _fitted(built), "batch_id", include_padding=True)
    evaluated = training_log.evaluate(losses.select("batch_id", "loss"), batches.target_tokens(collated))
    return _measured(evaluated)


def chunk_tokens(spark, sf_dir, given=sequences):
    """Every sequence in pieces of 512 ids."""
    cut = corpus.chunk_tokens(given(spark, sf_dir))
    return cut.select(
        "doc_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.col("token_count").cast("bigint").alias("token_count"),
        joined("tokens").alias("tokens"),
    )


def chunk_batches(spark, sf_dir, given=sequences):
    """Padded batches of the pieces, in the order of document and piece."""
    pieces = batches.filter_short(corpus.chunk_tokens(given(spark, sf_dir)).select("doc_id", "chunk", "tokens"))
    collated = batches.collate(batches.assign_batches(pieces, ["doc_id", "chunk"]))
    rows = F.array_join(F.transform("rows", joined), ";")
    return collated.select("batch_id", F.col("width").cast("bigint").alias("width"), rows.alias("rows"))


QUERIES = {
    query.__name__: query
    for query in (bigram_fit, bigram_loss, bigram_split_loss, bigram_batch_loss, evaluate, chunk_tokens, chunk_batches)
}
QUERIES |= {f"{name}_full": functools.partial(query, given=full_sequences) for name, query in list(QUERIES.items())}

_BUILT_SQL = f"SELECT doc_id, {SPLIT_SQL} AS split, tokens[1:512] AS tokens FROM ({SEQUENCES_SQL})"
_PAIRS_OF = "unnest({0}[1:len({0}) - 1]) AS prev, unnest({0}[2:]) AS next"
_MODEL_SQL = f"""
WITH built AS MATERIALIZED ({_BUILT_SQL}),
pairs AS MATERIALIZED (
    SELECT prev, next, count(*) AS cnt FROM (SELECT {_PAIRS_OF.format("tokens")} FROM built WHERE split = 'train' AND len(tokens) > 1)
    GROUP BY prev, next),
contexts AS MATERIALIZED (SELECT prev, sum(cnt) AS total FROM pairs GROUP BY prev)
"""
_LOSS = f"-ln((coalesce(cnt, 0) + 1) / (coalesce(total, 0) + {_VOCAB_SIZE})::DOUBLE)"
_LOSSES = f"SELECT *, {_LOSS} AS loss FROM {{}} LEFT JOIN pairs USING (prev, next) LEFT JOIN contexts USING (prev)"
_MEASURES = (
    "round(coalesce(avg(loss), 'inf'::DOUBLE), 6) AS loss, count(loss) AS num_tokens,"
    " round(exp(coalesce(avg(loss), 'inf'::DOUBLE)), 3) AS perplexity"
)
_VAL_SQL = """
numbered AS (
    SELECT tokens, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM built WHERE split = 'val' AND len(tokens) >= 2),
padded AS MATERIALIZED (
    SELECT batch_id, list_resize(tokens, max(len(tokens)) OVER (PARTITION BY batch_id), 0) AS row, tokens FROM numbered)
"""
_CHUNKS_SQL = (
    "SELECT doc_id, i AS chunk, tokens[i * 512 + 1:i * 512 + 512] AS tokens FROM (SELECT doc_id, tokens,"
    f" unnest(range(greatest(ceil(len(tokens) / 512)::BIGINT, 1))) AS i FROM ({SEQUENCES_SQL}))"
)


def _loss_sql(keys: str) -> str:
    """Every document's pairs; those without any keep a row."""
    return (
        f"{_MODEL_SQL}, scored AS ({_LOSSES.format(f'(SELECT doc_id, split, {_PAIRS_OF.format("tokens")} FROM built)')})"
        f" SELECT {keys}, {_MEASURES} FROM (SELECT DISTINCT {keys} FROM built) LEFT JOIN scored USING ({keys}) GROUP BY {keys}"
    )


ORACLES = {
    "bigram_fit": (
        f"{_MODEL_SQL} SELECT prev, next, cnt, total::BIGINT AS total,"
        f" round((cnt + 1) / (total + {_VOCAB_SIZE})::DOUBLE, 9) AS p FROM pairs JOIN contexts USING (prev)"
    ),
    "bigram_loss": _loss_sql("doc_id, split"),
    "bigram_split_loss": _loss_sql("split"),
    "bigram_batch_loss": (
        f"{_MODEL_SQL}, {_VAL_SQL},"
        f" paired AS (SELECT batch_id, true AS padding, {_PAIRS_OF.format('row')} FROM padded"
        f" UNION ALL SELECT batch_id, false, {_PAIRS_OF.format('tokens')} FROM padded)"
        f" SELECT batch_id, padding, {_MEASURES} FROM ({_LOSSES.format('paired')}) GROUP BY batch_id, padding"
    ),
    "evaluate": (
        f"{_MODEL_SQL}, {_VAL_SQL}"
        f" SELECT {_MEASURES} FROM ({_LOSSES.format(f'(SELECT {_PAIRS_OF.format("row")} FROM padded)')})"
    ),
    "chunk_tokens": (
        f"SELECT doc_id, chunk, len(tokens) AS token_count, array_to_string(tokens, ' ') AS tokens FROM ({_CHUNKS_SQL})"
    ),
    "chunk_batches": (
        "SELECT batch_id, max(width)::BIGINT AS width,"
        " string_agg(array_to_string(list_resize(tokens, width, 0), ' '), ';' ORDER BY doc_id, chunk) AS rows FROM"
        " (SELECT *, max(len(tokens)) OVER (PARTITION BY batch_id) AS width FROM"
        " (SELECT *, (row_number() OVER (ORDER BY doc_id, chunk) - 1) // 8 AS batch_id"
        f" FROM ({_CHUNKS_SQL}) WHERE len(tokens) >= 2)) GROUP BY batch_id"
    ),
}
