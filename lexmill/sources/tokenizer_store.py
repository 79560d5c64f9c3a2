"""Saving and loading a trained vocabulary."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.tokens import SPECIAL_TOKENS, UNK_ID
from lexmill.operators.bpe import MERGES_SCHEMA, VOCAB_SCHEMA, Tokenizer
from lexmill.operators.encoding import vocabulary_of


def write_tokenizer(tokenizer: Tokenizer, path: str) -> None:
    """Write ``vocab`` and ``merges`` as Parquet tables below ``path``."""
    tokenizer.vocab.write.parquet(f"{path}/vocab")
    tokenizer.merges.write.parquet(f"{path}/merges")


def read_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    def table(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException as cause:
            raise FileNotFoundError(f"no trained tokenizer at {path}") from cause

    return Tokenizer(table("vocab", VOCAB_SCHEMA), table("merges", MERGES_SCHEMA))


def tokenizer_json(tokenizer: Tokenizer) -> str:
    """The vocabulary in the public ``tokenizer.json`` format."""
    tokens = vocabulary_of(tokenizer.vocab)
    merges = [
        [tokens[row["left_id"]], tokens[row["right_id"]]] for row in tokenizer.merges.orderBy("rank").collect()
    ]
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [
                {
                    "id": token_id,
                    "content": token,
                    "single_word": False,
                    "lstrip": False,
                    "rstrip": False,
                    "normalized": False,
                    "special": True,
                }
                for token_id, token in enumerate(SPECIAL_TOKENS)
            ],
            "normalizer": {
                "type": "Sequence",
                "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}, {"type": "StripAccents"}],
            },
            "pre_tokenizer": byte_level,
            "post_processor": None,
            "decoder": byte_level,
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": SPECIAL_TOKENS[UNK_ID],
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": False,
                "vocab": {token: token_id for token_id, token in enumerate(tokens)},
                "merges": merges,
            },
        },
        ensure_ascii=False,
    )


def write_tokenizer_json(tokenizer: Tokenizer, path: str) -> None:
    """Write ``tokenizer.json`` content as the single text file of a folder."""
    spark = tokenizer.vocab.sparkSession
    spark.createDataFrame([(tokenizer_json(tokenizer),)], "value string").coalesce(1).write.text(path)


def read_tokenizer_json(spark: SparkSession, path: str) -> Tokenizer:
    """Load a byte-level BPE vocabulary from a ``tokenizer.json`` file."""
    schema = "model struct<vocab:map<string,int>,merges:array<array<string>>>"
    model = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["model"].alias("model"))
    vocab = model.select(F.explode("model.vocab").alias("token", "id")).select("id", "token")
    merges = model.select(F.posexplode("model.merges").alias("rank", "pair")).select(
        "rank", F.col("pair")[0].alias("left"), F.col("pair")[1].alias("right")
    )

    def ids(alias: str, token) -> DataFrame:
        return vocab.select(F.col("id").alias(f"{alias}_id"), F.col("token").alias(token))

    joined = (
        merges.withColumn("new", F.concat("left", "right"))
        .join(ids("left", "left"), "left")
        .join(ids("right", "right"), "right")
        .join(ids("new", "new"), "new")
    )
    return Tokenizer(vocab, joined.select("rank", "left_id", "right_id", "new_id"))
