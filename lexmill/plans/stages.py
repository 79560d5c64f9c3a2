"""The stages of a corpus build, each reading what the one before it wrote."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.cleaning import strip_nested_templates
from lexmill.operators import audit, batches, corpus
from lexmill.operators.bpe import MIN_FREQUENCY, VOCAB_SIZE, Tokenizer, train_bpe
from lexmill.operators.encoding import encode
from lexmill.session import materialize
from lexmill.sources import articles
from lexmill.sources.sequences import read_sequences, write_splits
from lexmill.sources.tables import spread
from lexmill.sources.tokenizer_store import read_tokenizer, write_tokenizer
from lexmill.sources.wiki_dump import read_wiki_dump


def extract(spark: SparkSession, dump: str, target: str) -> None:
    """Dump to JSON lines with ``id``, ``title`` and ``text`` without templates."""
    pages = read_wiki_dump(spark, dump)
    text = strip_nested_templates("text").alias("text")
    pages.select(F.col("page_id").alias("id"), "title", text).write.json(target)


def clean(spark: SparkSession, extracted: str, target: str) -> DataFrame:
    """JSON lines to cleaned articles; returns the ledger of the files read.

    Files are read for the ledger and again for their texts; a file lost in between is an error.
    """
    scan = articles.scan_jsonl(spark, extracted)
    ledger = materialize(articles.with_reasons(materialize(articles.load_ledger(scan)), extracted))
    articles.write_cleaned(corpus.clean_articles(articles.accepted(scan, ledger)), target)
    expected = articles.ledger_totals(ledger).collect()[0]["articles"]
    if expected and spark.read.parquet(target).count() != expected:
        raise RuntimeError(f"{extracted} changed while it was read: {target} lacks articles of its ledger")
    return ledger


def read_cleaned(spark: SparkSession, cleaned: str) -> DataFrame:
    """Cleaned articles; an empty corpus is an error."""
    return articles.require_nonempty(spark.read.parquet(cleaned))


def learn_tokenizer(
    spark: SparkSession,
    cleaned: str,
    target: str,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
) -> Tokenizer:
    """Cleaned articles to a stored vocabulary."""
    texts = spread(read_cleaned(spark, cleaned).select("text"))
    write_tokenizer(train_bpe(texts, vocab_size, min_frequency), target)
    return read_tokenizer(spark, target)


def build_corpus(
    spark: SparkSession, cleaned: str, tokenizer: str, target: str, ratio: float = corpus.TRAIN_RATIO, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Cleaned articles to stored train and validation sequences.

    Returns corpus statistics and split shares. The split goes by a hash of the
    article, so equal articles always fall into the same one. Texts are encoded
    once; statistics read the stored lengths.
    """
    texts = spread(read_cleaned(spark, cleaned).select("file", "title", "text"))
    encoded = encode(texts, read_tokenizer(spark, tokenizer), ids="tokens")
    keyed = encoded.select(F.xxhash64("file", "title", "text").alias("key"), "tokens")
    write_splits(corpus.split_corpus(corpus.truncate_tokens(keyed), "key", ratio, seed), target)
    stored = spark.read.parquet(target)
    return corpus.corpus_stats(stored), corpus.split_shares(stored)


def training_batches(
    spark: SparkSession, sequences: str, split: str, epoch: int | None = None, seed: int = 0
) -> DataFrame:
    """Stored sequences to padded batches, in stored order or shuffled for an epoch."""
    rows = batches.filter_short(read_sequences(spark, sequences, split), count="token_count")
    if epoch is None:
        return batches.collate(batches.assign_batches(rows, ["part", "row"]))
    return batches.collate(batches.shuffle_rows(rows, ["part", "row"], epoch, seed))


def audit_cleaned(spark: SparkSession, folder: str, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Array files to audit totals, the folder roll-up and the ranked file list."""
    counts = articles.count_array_files(spark, folder)
    return audit.audit_totals(counts), audit.folder_rollup(counts), audit.rank_files(counts, k)
