"""Counts behind vocabulary training: words, symbols and adjacent pairs.

A word in training is one string in which every character is one vocabulary
symbol, so that joining a pair is a plain string replacement.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col
from lexmill.functions.tokens import SPECIAL_TOKENS, byte_symbols, words_of


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every word; words are summed within each task first."""
    return (
        df.select(F.explode(words_of(text)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def symbol_words(counts: DataFrame) -> DataFrame:
    """Words as byte symbols."""
    return counts.select(byte_symbols("word").alias("word"), "cnt")


def alphabet(words: DataFrame) -> DataFrame:
    """The distinct symbols of all words; at most 256 rows."""
    return words.select(F.explode(F.split("word", "")).alias("token")).distinct()


def init_vocab(words: DataFrame) -> DataFrame:
    """Special tokens, then the alphabet by code point: ``(id, token)``."""
    spark = words.sparkSession
    specials = spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id int, token string")
    symbols = alphabet(words).agg(F.array_sort(F.collect_set("token")).alias("symbols"))
    ranked = symbols.select(F.posexplode("symbols").alias("pos", "token")).select(
        (F.col("pos") + len(SPECIAL_TOKENS)).alias("id"), "token"
    )
    return specials.unionByName(ranked)


def adjacent_pairs(col) -> Column:
    """All overlapping two-symbol strings of a word; symbols may lie beyond U+FFFF, which regular expressions split."""
    symbols = F.split(_col(col), "")
    return F.transform(
        F.slice(symbols, 1, F.greatest(F.size(symbols) - 1, F.lit(0))),
        lambda symbol, at: F.concat(symbol, F.get(symbols, at + 1)),
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent pairs weighted by word count: ``(pair, cnt)``."""
    return (
        words.select(F.explode(adjacent_pairs("word")).alias("pair"), "cnt")
        .groupBy("pair")
        .agg(F.sum("cnt").alias("cnt"))
    )
