"""Cleaned articles, truncation, the train/validation split and its statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col, clean_text
from lexmill.functions.markup import letter_share
from lexmill.functions.sequences import chunks, clip

MAX_LENGTH = 512
TRAIN_RATIO = 0.8
MIN_LETTERS = 0.5
TRAIN, VAL = "train", "val"


def clean_articles(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Title and cleaned text; what is missing becomes the empty string."""
    return df.withColumns(
        {
            title: F.coalesce(F.col(title), F.lit("")),
            text: clean_text(F.coalesce(F.col(text), F.lit(""))),
        }
    )


def keep_prose(df: DataFrame, min_share: float = MIN_LETTERS, text: str = "text") -> DataFrame:
    """Rows whose text is letters for the most part; null texts and those without a character are dropped."""
    return df.filter((F.length(text) > 0) & (letter_share(text) >= min_share))


def truncate_tokens(df: DataFrame, max_length: int = MAX_LENGTH, tokens: str = "tokens") -> DataFrame:
    """Clip the sequence; ``token_count`` keeps the length before clipping."""
    count = F.size(tokens)
    return df.withColumns(
        {
            "token_count": count,
            "truncated": count > max_length,
            tokens: clip(tokens, max_length),
        }
    )


def chunk_tokens(df: DataFrame, max_length: int = MAX_LENGTH, tokens: str = "tokens") -> DataFrame:
    """Cut every sequence into rows of ``max_length`` tokens instead of clipping it.

    ``chunk`` numbers the pieces of a sequence from 0, so a row's key together with
    it orders batches; ``token_count`` is the length of the piece. The last piece is
    short; a sequence without tokens stays one row without. Nothing is shuffled.
    """
    pieces = chunks(tokens, max_length)
    others = [name for name in df.columns if name not in (tokens, "chunk", "token_count")]
    cut = df.select(*others, F.posexplode_outer(pieces).alias("_at", "_piece"))
    piece = F.coalesce("_piece", F.array().cast(df.schema[tokens].dataType))
    return cut.select(
        *others, F.coalesce("_at", F.lit(0)).alias("chunk"), F.size(piece).alias("token_count"), piece.alias(tokens)
    )


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def split_corpus(
    df: DataFrame, key: str, ratio: float = TRAIN_RATIO, seed: int = 0, tokens: str = "tokens"
) -> DataFrame:
    """Assign every row to train or val by a hash of its key.

    The draw is independent per row and survives retries and repartitioning.
    Rows without tokens always go to val.
    """
    draw = unit_hash(F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string")))
    split = F.when((F.size(tokens) > 0) & (draw < ratio), TRAIN).otherwise(VAL)
    return df.withColumn("split", split)


def corpus_stats(df: DataFrame) -> DataFrame:
    """One row of totals over ``token_count`` and ``truncated``, one pass."""
    truncated = F.count_if("truncated")
    articles = F.count(F.lit(1))
    return df.agg(
        articles.alias("articles"),
        truncated.alias("truncated_articles"),
        F.when(articles > 0, truncated / articles * 100).alias("truncated_pct"),
        F.avg("token_count").alias("mean_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
    )


def split_shares(df: DataFrame) -> DataFrame:
    """Samples and percentage per split; one aggregate, unpivoted to two rows."""
    totals = df.agg(*[F.count_if(F.col("split") == name).alias(name) for name in (TRAIN, VAL)])
    total = F.col(TRAIN) + F.col(VAL)
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("split"),
                        F.col(name).alias("samples"),
                        F.when(total > 0, F.col(name) / total * 100).alias("pct"),
                    )
                    for name in (TRAIN, VAL)
                ]
            )
        ).alias("share")
    ).select("share.*")
