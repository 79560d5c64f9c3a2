"""Inputs that queries derive from the given tables, in Spark and in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.cleaning import WHITESPACE
from lexmill.functions.tokens import byte_alphabet, words_of
from lexmill.sources.tables import read_table


def char_sql(text: str) -> str:
    """A string as SQL, character by character."""
    return "||".join(f"chr({ord(char)})" for char in text)


# Articles with wiki markup: the given documents hold none.
_BEFORE, _AFTER = "{{Infobox|id=", "}}\n== Titre ==\n=== Sous-titre ===\n"
_MULTILINE, _CATEGORY, _END = "\n{{a {{b}} c}} {{x\ny}} [[Catégorie:", "|é]] [[catégorie:x]] ", " \u0085\t\r\n "

MARKED_UP_SQL = (
    f"{char_sql(_BEFORE)} || doc_id || {char_sql(_AFTER)} || text || {char_sql(_MULTILINE)}"
    f" || source || {char_sql(_CATEGORY)} || upper(lang) || {char_sql(_END)}"
)
WHITESPACE_SQL = char_sql(WHITESPACE)


def marked_up() -> Column:
    return F.concat(
        F.lit(_BEFORE),
        F.col("doc_id").cast("string"),
        F.lit(_AFTER),
        F.col("text"),
        F.lit(_MULTILINE),
        F.col("source"),
        F.lit(_CATEGORY),
        F.upper("lang"),
        F.lit(_END),
    )


def marked_up_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").withColumn("text", marked_up())


# Words. RE2 has no look-ahead, so a mark is put before the last white space of a
# run that a word follows, and the word pattern then steps over the mark.
_MARK = "chr(57344)"


def words_sql(text: str) -> str:
    normal = f"strip_accents(lower({text}))"
    marked = rf"regexp_replace({normal}, '(\s+)(\s)(\S)', '\1' || {_MARK} || '\2\3', 'g')"
    pattern = (
        r"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}' || " + _MARK + r" || ']+|\s+'"
    )
    return f"regexp_extract_all({marked}, {pattern})"


def byte_symbols_sql(word: str) -> str:
    alphabet = char_sql(byte_alphabet())
    return (
        f"array_to_string(list_transform(range(length(hex({word})) // 2),"
        f" lambda i: substr({alphabet}, ('0x' || substr(hex({word}), 2 * i + 1, 2))::INT + 1, 1)), '')"
    )


# Token ids that need no trained vocabulary: one id per word from its length and
# last letter.
def word_ids(text) -> Column:
    return F.transform(
        words_of(text),
        lambda word: F.lit(7) + (F.ascii(F.right(word, F.lit(1))) * 131 + F.length(word)) % 31993,
    )


def word_ids_sql(text: str) -> str:
    return (
        f"list_transform({words_sql(text)}, lambda w: (7 + (unicode(right(w, 1)) * 131 + length(w)) % 31993)::INT)"
    )


# Sequences without an id and with one stand beside those of the documents. Their
# language sorts first, so that whole batches hold nothing else.
ADDED_SEQUENCES = 24


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id sequence per document, of its whole text, and the added short ones."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_ids("text").alias("tokens"))
    return with_added(spark, documents)


def with_added(spark: SparkSession, documents: DataFrame) -> DataFrame:
    added = spark.range(1, ADDED_SEQUENCES + 1).select(
        (-F.col("id")).alias("doc_id"),
        F.lit("aa").alias("lang"),
        F.lit("added").alias("source"),
        F.when(F.col("id") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(7))).alias("tokens"),
    )
    return documents.unionByName(added)


SEQUENCES_SQL = (
    f"SELECT doc_id, lang, source, {word_ids_sql('text')} AS tokens FROM documents UNION ALL"
    " SELECT -i, 'aa', 'added', CASE WHEN i % 2 = 0 THEN []::INT[] ELSE [7]::INT[] END"
    f" FROM (SELECT unnest(range(1, {ADDED_SEQUENCES + 1}))::BIGINT AS i)"
)

SPLIT_SQL = (
    "CASE WHEN len(tokens) > 0 AND ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.8"
    " THEN 'train' ELSE 'val' END"
)


def joined(tokens) -> Column:
    """An id array as text, for comparing results."""
    return F.array_join(F.transform(tokens, lambda token: token.cast("string")), " ")


# Training logs: events in id order are the steps of three epochs.
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = events.agg(F.floor((F.count(F.lit(1)) + 2) / 3)).scalar()
    return events.select(
        F.floor(F.col("event_id") / steps).alias("epoch"),
        (F.col("event_id") % steps).alias("step"),
        (F.col("value") / 100).alias("loss"),
        (1 + F.col("user_id") % 7).alias("num_tokens"),
    )


STEP_METRICS_SQL = (
    "SELECT event_id // steps AS epoch, event_id % steps AS step, value / 100 AS loss,"
    " 1 + user_id % 7 AS num_tokens FROM events, (SELECT (count(*) + 2) // 3 AS steps FROM events)"
)


# One epoch per day: views are its validation, all other events its training.
def daily_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("epoch"),
        (F.col("event_type") == "view").alias("is_val"),
        (F.col("value") / 100).alias("loss"),
        (1 + F.col("user_id") % 7).alias("num_tokens"),
        F.col("value").alias("seconds"),
    )


DAILY_STEPS_SQL = (
    "SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, event_type = 'view' AS is_val,"
    " value / 100 AS loss, 1 + user_id % 7 AS num_tokens, value AS seconds FROM events"
)


def daily_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss and seconds per epoch, from one pass."""
    weighted = F.sum(F.when(F.col("is_val"), F.col("loss") * F.col("num_tokens")))
    evals = daily_steps(spark, sf_dir).groupBy("epoch").agg(
        (weighted / F.sum(F.when(F.col("is_val"), F.col("num_tokens")))).alias("val_loss"),
        F.sum("seconds").alias("epoch_seconds"),
        F.sum(F.when(F.col("is_val"), F.col("seconds")).otherwise(0.0)).alias("val_seconds"),
        F.count_if("is_val").alias("_evals"),
    )
    return evals.filter("_evals > 0").drop("_evals")


DAILY_EVALS_SQL = (
    "SELECT epoch, sum(loss * num_tokens) FILTER (is_val) / sum(num_tokens) FILTER (is_val) AS val_loss,"
    " sum(seconds) AS epoch_seconds, sum(CASE WHEN is_val THEN seconds ELSE 0 END) AS val_seconds"
    f" FROM ({DAILY_STEPS_SQL}) GROUP BY epoch HAVING count(*) FILTER (is_val) > 0"
)
DAILY_SUMMARY_SQL = (
    "SELECT epoch, train_loss, val_loss, epoch_seconds, val_seconds"
    " FROM (SELECT epoch, sum(loss * num_tokens) / sum(num_tokens) AS train_loss"
    f" FROM ({DAILY_STEPS_SQL}) WHERE NOT is_val GROUP BY epoch) JOIN ({DAILY_EVALS_SQL}) USING (epoch)"
)
