"""Stages of the corpus pipeline; all but the last return the columns of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontamination, minhash_dedup, quality, sentencepiece_codec, substring_dedup
from lexmill.llm.queries import SENTENCEPIECE_MODEL
from lexmill.llm.texts import own_columns, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this table and the labels, does not reject."""
    docs = docs.select(COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).where("kept").select(COLUMNS)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates by 5-word shingles."""
    return minhash_dedup.keep_first(docs.select(COLUMNS), size=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a document of a smaller id has too; ``n_chars`` follows."""
    left = substring_dedup.remove_repeats(docs.select(COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = own_columns(table(spark, sf_dir, "benchmark"), item_id="item_id", text="text")
    return decontamination.keep_clean(docs.select(COLUMNS), items)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left, how many, and whether decoding them gives the text again."""
    model = sentencepiece_codec.load_model(SENTENCEPIECE_MODEL)
    return sentencepiece_codec.encode_and_check(docs.select("doc_id", "text"), model).select("doc_id", "ids", "n_ids", "exact")


STAGES = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", first_of_near_copies),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encode_pieces),
]
