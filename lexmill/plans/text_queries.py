"""Queries over article texts: cleaning, words and counts."""

from pyspark.sql import functions as F

from lexmill.functions import cleaning
from lexmill.functions.tokens import byte_symbols, normalize_text, pretokenize, text_of_symbols, words_of
from lexmill.operators import corpus, vocabulary
from lexmill.plans.inputs import (
    MARKED_UP_SQL,
    WHITESPACE_SQL,
    byte_symbols_sql,
    marked_up_documents,
    words_sql,
)
from lexmill.sources.tables import read_table

_TEMPLATES = r"regexp_replace({}, '\{{\{{[^\n]*?\}}\}}', '', 'g')"
_CATEGORIES = r"regexp_replace({}, '\[\[Catégorie:[^\n]*?\]\]', '', 'g')"
_HEADINGS = r"regexp_replace({}, '==[^\n]*?==', '', 'g')"
_LOWER_TRIM = f"trim(lower({{}}), {WHITESPACE_SQL})"


def _cleaned(function):
    return lambda spark, sf_dir: marked_up_documents(spark, sf_dir).select("doc_id", function("text").alias("text"))


def _cleaned_sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


_CLEAN_SQL = _LOWER_TRIM.format(_HEADINGS.format(_CATEGORIES.format(_TEMPLATES.format(f"({MARKED_UP_SQL})"))))


def clean_articles(spark, sf_dir):
    given = marked_up_documents(spark, sf_dir).select("doc_id", F.col("source").alias("title"), "text")
    added = spark.createDataFrame(
        [(-1, None, "{{x}} Text"), (-2, "Titre", None), (-3, None, None)], "doc_id bigint, title string, text string"
    )
    return corpus.clean_articles(given.unionByName(added))


def _total_length(strings):
    return F.aggregate(strings, F.lit(0).cast("bigint"), lambda total, text: total + F.length(text))


def drop_blank_lines(spark, sf_dir):
    padded = F.concat("text", F.lit("\n \n\t \n"), F.col("source"))
    kept = F.filter(F.split(padded, "\n"), lambda line: ~cleaning.is_blank(line))
    return (
        read_table(spark, sf_dir, "documents")
        .select("doc_id", kept.alias("kept"))
        .select("doc_id", F.size("kept").cast("bigint").alias("lines"), _total_length("kept").alias("chars"))
    )


def records_with_text(spark, sf_dir):
    """Records of all documents, and beside them one without a text for each."""
    documents = read_table(spark, sf_dir, "documents")
    given = documents.select("doc_id", F.to_json(F.struct("source", "text")).alias("record"))
    added = documents.select((-1 - F.col("doc_id")).alias("doc_id"), F.to_json(F.struct("source")).alias("record"))
    records = given.unionByName(added).select("doc_id", F.from_json("record", "map<string,string>").alias("record"))
    return records.filter(F.map_contains_key("record", "text")).select(
        "doc_id", F.element_at("record", "text").alias("text")
    )


def union_articles(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents", "text").withColumn("origin", F.lit("documents"))
    turns = read_table(spark, sf_dir, "conversations", "text").withColumn("origin", F.lit("conversations"))
    return documents.unionByName(turns)


def pretokenized(spark, sf_dir):
    """Counts of each text's words, within its row; texts without a word are left out.

    Every character but a mark belongs to a word, so the filter needs no words: one
    on the words would be moved below their projection, and split each text twice.
    """
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").rlike(r"\P{M}"))
    return documents.select("doc_id", words_of("text").alias("words")).select(
        "doc_id",
        F.size("words").cast("bigint").alias("words"),
        _total_length("words").alias("chars"),
        F.array_max("words").alias("last_word"),
    )


def word_positions(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(pretokenize(normalize_text("text"))).alias("pos", "word")).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "word"
    )


def byte_mapped(spark, sf_dir):
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    symbols = words.withColumn("symbols", byte_symbols("word"))
    return symbols.withColumn("restored", text_of_symbols("symbols") == F.col("word"))


def _words(spark, sf_dir):
    return vocabulary.symbol_words(vocabulary.word_counts(read_table(spark, sf_dir, "documents", "text")))


def init_vocab(spark, sf_dir):
    return vocabulary.init_vocab(_words(spark, sf_dir)).select(F.col("id").cast("bigint").alias("id"), "token")


_COUNTS_SQL = f"SELECT word, count(*) AS cnt FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word"
SYMBOL_WORDS_SQL = f"SELECT {byte_symbols_sql('word')} AS word, cnt FROM ({_COUNTS_SQL})"
_SPECIALS_SQL = (
    "SELECT * FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]'), (5, '[BOS]'),"
    " (6, '[EOS]')) AS t(id, token)"
)
ALPHABET_SQL = (
    "SELECT 6 + row_number() OVER (ORDER BY unicode(token)) AS id, token FROM"
    f" (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM ({SYMBOL_WORDS_SQL}))"
)

QUERIES = {
    "strip_templates": _cleaned(cleaning.strip_templates),
    "strip_categories": _cleaned(cleaning.strip_categories),
    "strip_headings": _cleaned(cleaning.strip_headings),
    "lower_trim": _cleaned(cleaning.lower_trim),
    "clean_text": _cleaned(cleaning.clean_text),
    "clean_articles": clean_articles,
    "drop_blank_lines": drop_blank_lines,
    "records_with_text": records_with_text,
    "union_articles": union_articles,
    "normalize_text": lambda spark, sf_dir: read_table(spark, sf_dir, "documents").select(
        "doc_id", normalize_text("text").alias("text")
    ),
    "pretokenize": pretokenized,
    "word_positions": word_positions,
    "byte_symbols": byte_mapped,
    "word_counts": lambda spark, sf_dir: vocabulary.word_counts(read_table(spark, sf_dir, "documents", "text")),
    "init_vocab": init_vocab,
    "pair_counts": lambda spark, sf_dir: vocabulary.pair_counts(_words(spark, sf_dir)),
}

ORACLES = {
    "strip_templates": _cleaned_sql(_TEMPLATES.format(f"({MARKED_UP_SQL})")),
    "strip_categories": _cleaned_sql(_CATEGORIES.format(f"({MARKED_UP_SQL})")),
    "strip_headings": _cleaned_sql(_HEADINGS.format(f"({MARKED_UP_SQL})")),
    "lower_trim": _cleaned_sql(_LOWER_TRIM.format(f"({MARKED_UP_SQL})")),
    "clean_text": _cleaned_sql(_CLEAN_SQL),
    "clean_articles": (
        f"SELECT doc_id, source AS title, {_CLEAN_SQL} AS text FROM documents"
        " UNION ALL SELECT * FROM (VALUES (-1, '', 'text'), (-2, 'Titre', ''), (-3, '', ''))"
    ),
    "drop_blank_lines": (
        "SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split("
        "text || chr(10) || ' ' || chr(10) || chr(9) || chr(160) || chr(10) || source, chr(10))) AS line FROM documents)"
        f" WHERE trim(line, {WHITESPACE_SQL}) <> '' GROUP BY doc_id"
    ),
    "records_with_text": "SELECT doc_id, text FROM documents",
    "union_articles": (
        "SELECT text, 'documents' AS origin FROM documents UNION ALL SELECT text, 'conversations' FROM conversations"
    ),
    "normalize_text": "SELECT doc_id, strip_accents(lower(text)) AS text FROM documents",
    "pretokenize": (
        "SELECT doc_id, count(*) AS words, sum(length(word))::BIGINT AS chars, max(word) AS last_word FROM"
        f" (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents) GROUP BY doc_id"
    ),
    "word_positions": (
        "SELECT conv_id, turn, (generate_subscripts(w, 1) - 1)::BIGINT AS pos, unnest(w) AS word FROM"
        f" (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations)"
    ),
    "byte_symbols": (
        f"SELECT word, {byte_symbols_sql('word')} AS symbols, true AS restored FROM"
        " (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)"
    ),
    "word_counts": _COUNTS_SQL,
    "init_vocab": f"{_SPECIALS_SQL} UNION ALL SELECT id, token FROM ({ALPHABET_SQL})",
    "pair_counts": (
        "SELECT pair, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(list_transform(range(1, length(word)),"
        f" lambda i: substr(word, i, 2))) AS pair, cnt FROM ({SYMBOL_WORDS_SQL})) GROUP BY pair"
    ),
}
