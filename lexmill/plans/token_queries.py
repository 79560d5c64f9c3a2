"""Queries with a vocabulary trained on the documents."""

import functools

from pyspark.sql import functions as F

from lexmill.operators import batches, bpe, corpus, encoding
from lexmill.plans.inputs import SPLIT_SQL, byte_symbols_sql, joined, with_added, words_sql
from lexmill.plans.text_queries import ALPHABET_SQL, SYMBOL_WORDS_SQL
from lexmill.session import new_shared_path
from lexmill.sources.tables import read_table
from lexmill.sources.tokenizer_store import read_tokenizer, write_tokenizer

# How far SQL can repeat the training, one recursion step per merge over all words.
# The queries named ``_full`` do the same with the default size.
VOCAB_SIZE = 300


@functools.lru_cache(maxsize=None)
def _stored(spark, application, sf_dir, size):
    documents = read_table(spark, sf_dir, "documents", "text")
    path = new_shared_path(spark, "tokenizer")
    write_tokenizer(bpe.train_bpe(documents, size), path)
    return path


def trained(spark, sf_dir, size=VOCAB_SIZE):
    """The documents' vocabulary, trained once per application and then loaded."""
    return read_tokenizer(spark, _stored(spark, spark.sparkContext.applicationId, sf_dir, size))


def train_bpe(spark, sf_dir):
    merges = bpe.train_bpe(read_table(spark, sf_dir, "documents", "text"), VOCAB_SIZE).merges
    return merges.select([F.col(name).cast("bigint").alias(name) for name in merges.columns])


def vocabulary(spark, sf_dir, size=VOCAB_SIZE):
    return trained(spark, sf_dir, size).vocab.select(F.col("id").cast("bigint").alias("id"), "token")


def encode(spark, sf_dir, size=VOCAB_SIZE):
    encoded = encoding.encode(read_table(spark, sf_dir, "documents"), trained(spark, sf_dir, size))
    return encoded.select("doc_id", joined("ids").alias("ids"))


def _encoded_turns(spark, sf_dir, size=VOCAB_SIZE):
    turns = read_table(spark, sf_dir, "conversations")
    return encoding.encode(turns, trained(spark, sf_dir, size)).select("conv_id", "turn", "text", "ids")


def decode(spark, sf_dir, size=VOCAB_SIZE):
    tokenizer = trained(spark, sf_dir, size)
    encoded = encoding.encode(read_table(spark, sf_dir, "documents"), tokenizer)
    return encoding.decode(encoded, tokenizer.vocab).select("doc_id", "decoded")


def explode_tokens(spark, sf_dir, size=VOCAB_SIZE):
    listed = encoding.explode_tokens(_encoded_turns(spark, sf_dir, size).drop("text"), trained(spark, sf_dir, size).vocab)
    return listed.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token", F.col("id").cast("bigint").alias("id")
    )


def token_stats(spark, sf_dir, size=VOCAB_SIZE):
    stats = encoding.token_stats(_encoded_turns(spark, sf_dir, size), trained(spark, sf_dir, size).vocab)
    return stats.select(
        "conv_id",
        "turn",
        F.col("token_count").cast("bigint").alias("token_count"),
        F.col("vocab_size").cast("bigint").alias("vocab_size"),
        F.round("chars_per_token", 6).alias("chars_per_token"),
    )


def roundtrip_ok(spark, sf_dir, size=VOCAB_SIZE):
    tokenizer = trained(spark, sf_dir, size)
    encoded = encoding.encode(read_table(spark, sf_dir, "documents"), tokenizer)
    checked = encoding.roundtrip_ok(encoding.decode(encoded, tokenizer.vocab))
    return checked.select("doc_id", "roundtrip_ok")


def train_bpe_full(spark, sf_dir):
    """The default vocabulary; SQL cannot recurse that far, the tests compare it with the public library."""
    merges = bpe.train_bpe(read_table(spark, sf_dir, "documents", "text")).merges
    return merges.select([F.col(name).cast("bigint").alias(name) for name in merges.columns])


def _corpus(spark, sf_dir, size=VOCAB_SIZE):
    encoded = encoding.encode(read_table(spark, sf_dir, "documents"), trained(spark, sf_dir, size), ids="tokens")
    return corpus.split_corpus(corpus.truncate_tokens(encoded.select("doc_id", "tokens")), "doc_id")


def encoded_corpus(spark, sf_dir, size=VOCAB_SIZE):
    """Texts to vocabulary ids, truncated and split."""
    return _corpus(spark, sf_dir, size).select(
        "doc_id", "split", F.col("token_count").cast("bigint").alias("token_count"), "truncated", joined("tokens").alias("tokens")
    )


def encoded_batches(spark, sf_dir, size=VOCAB_SIZE):
    """Padded batches of the encoded training texts."""
    train = batches.filter_short(_corpus(spark, sf_dir, size).filter("split = 'train'"))
    rows = F.array_join(F.transform("rows", joined), ";")
    collated = batches.collate(batches.assign_batches(train, "doc_id"))
    return collated.select("batch_id", F.col("width").cast("bigint").alias("width"), rows.alias("rows"))


def full_sequences(spark, sf_dir):
    """The ids of the default vocabulary for every document's whole text, and the added short sequences."""
    encoded = encoding.encode(read_table(spark, sf_dir, "documents"), trained(spark, sf_dir, bpe.VOCAB_SIZE), ids="tokens")
    return with_added(spark, encoded.select("doc_id", "lang", "source", "tokens"))


QUERIES = {
    "train_bpe": train_bpe,
    "train_bpe_full": train_bpe_full,
    "encoded_corpus": encoded_corpus,
    "encoded_batches": encoded_batches,
    "vocabulary": vocabulary,
    "encode": encode,
    "decode": decode,
    "explode_tokens": explode_tokens,
    "token_stats": token_stats,
    "roundtrip_ok": roundtrip_ok,
}
QUERIES |= {
    f"{query.__name__}_full": functools.partial(query, size=bpe.VOCAB_SIZE)
    for query in (
        vocabulary, encode, decode, explode_tokens, token_stats, roundtrip_ok, encoded_corpus, encoded_batches
    )
}

# Training in SQL: every word is a string of one character per symbol, and each
# recursion step replaces the most frequent pair, ties by smaller ids.
_TRAINING = f"""
WITH RECURSIVE
symbol_words AS MATERIALIZED ({SYMBOL_WORDS_SQL}),
letters AS MATERIALIZED ({ALPHABET_SQL.replace(f"({SYMBOL_WORDS_SQL})", "symbol_words")}),
codes AS MATERIALIZED (
    SELECT string_agg(token, '' ORDER BY id) AS plain, string_agg(chr((id + 256)::INT), '' ORDER BY id) AS coded,
    7 + count(*) AS size FROM letters),
steps AS (
    SELECT size AS next, translate(word, plain, coded) AS word, cnt, NULL::VARCHAR AS pair FROM symbol_words, codes
    UNION ALL
    SELECT next + 1, replace(word, best.pair, chr((next + 256)::INT)), cnt, best.pair
    FROM steps, (
        SELECT pair FROM (
            SELECT unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS pair, cnt FROM steps)
        GROUP BY pair ORDER BY sum(cnt) DESC, pair LIMIT 1) best
    WHERE next < {VOCAB_SIZE}),
merges AS MATERIALIZED (
    SELECT DISTINCT next - 1 - size AS rank, pair, next - 1 AS new_id FROM steps, codes WHERE pair IS NOT NULL),
rules AS MATERIALIZED (SELECT list(pair || chr((new_id + 256)::INT) ORDER BY rank) AS list FROM merges),
spelled AS MATERIALIZED (
    SELECT list_reduce(list([chr(unicode(pair[1])), chr(unicode(pair[2]))] ORDER BY rank),
        lambda known, parts: list_append(known, known[unicode(parts[1]) - 255] || known[unicode(parts[2]) - 255]),
        ['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '[BOS]', '[EOS]'] || any_value(plain)) AS tokens
    FROM merges, (SELECT list(token ORDER BY id) AS plain FROM letters))
"""


def _encoded_sql(table: str, key: str) -> str:
    """Text to symbol strings in ``symbols``: distinct words are joined once."""
    return f"""{_TRAINING},
parts AS MATERIALIZED (
    SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS nth FROM (SELECT {key}, {words_sql('text')} AS w FROM {table})),
known AS MATERIALIZED (
    SELECT word, list_reduce(list, lambda made, rule: replace(made, rule[1:2], rule[3:3]),
        translate({byte_symbols_sql('word')}, plain, coded)) AS symbols
    FROM (SELECT DISTINCT word FROM parts), rules, codes),
encoded AS MATERIALIZED (
    SELECT {key}, string_agg(symbols, '' ORDER BY nth) AS symbols FROM parts JOIN known USING (word) GROUP BY {key})
"""


_IDS = "list_transform(string_split(symbols, ''), lambda s: unicode(s) - 256)"
_TOKENS = "list_transform(string_split(symbols, ''), lambda s: tokens[unicode(s) - 255])"
_TURN = "conv_id, turn"

_CORPUS = f"""{_encoded_sql('documents', 'doc_id')},
built AS MATERIALIZED (
    SELECT doc_id, {SPLIT_SQL} AS split, len(tokens) AS token_count, len(tokens) > 512 AS truncated,
        tokens[1:512] AS tokens
    FROM (SELECT doc_id, {_IDS} AS tokens FROM encoded))
"""

ORACLES = {
    "encoded_corpus": (
        f"{_CORPUS} SELECT doc_id, split, token_count, truncated, array_to_string(tokens, ' ') AS tokens FROM built"
    ),
    "encoded_batches": (
        f"{_CORPUS} SELECT batch_id, max(width)::BIGINT AS width,"
        " string_agg(array_to_string(list_resize(tokens, width, 0), ' '), ';' ORDER BY doc_id) AS rows FROM"
        " (SELECT *, max(len(tokens)) OVER (PARTITION BY batch_id) AS width FROM"
        " (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM built"
        " WHERE split = 'train' AND len(tokens) >= 2)) GROUP BY batch_id"
    ),
    "train_bpe": (
        f"{_TRAINING} SELECT rank, (unicode(pair[1]) - 256)::BIGINT AS left_id,"
        " (unicode(pair[2]) - 256)::BIGINT AS right_id, new_id FROM merges"
    ),
    "vocabulary": (
        f"{_TRAINING} SELECT (generate_subscripts(tokens, 1) - 1)::BIGINT AS id, unnest(tokens) AS token FROM spelled"
    ),
    "encode": f"{_encoded_sql('documents', 'doc_id')} SELECT doc_id, array_to_string({_IDS}, ' ') AS ids FROM encoded",
    # Joining and splitting lose nothing, so decoding gives the normalised text.
    "decode": "SELECT doc_id, strip_accents(lower(text)) AS decoded FROM documents",
    "explode_tokens": (
        f"{_encoded_sql('conversations', _TURN)} SELECT {_TURN}, generate_subscripts({_IDS}, 1)::BIGINT AS pos,"
        f" unnest({_TOKENS}) AS token, unnest({_IDS})::BIGINT AS id FROM encoded, spelled"
    ),
    "token_stats": (
        f"{_encoded_sql('conversations', _TURN)} SELECT {_TURN}, length(symbols) AS token_count,"
        f" {VOCAB_SIZE}::BIGINT AS vocab_size, round(length(text) / length(symbols), 6) AS chars_per_token"
        f" FROM encoded JOIN conversations USING ({_TURN})"
    ),
    "roundtrip_ok": (
        "SELECT doc_id, contains(lower(text), strip_accents(lower(text)))"
        " OR contains(strip_accents(lower(text)), lower(text)) AS roundtrip_ok FROM documents"
    ),
}
