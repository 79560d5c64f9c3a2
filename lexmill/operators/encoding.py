"""Text to token ids and back with a trained vocabulary."""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cleaning import _col
from lexmill.functions.joins import join_table, join_words, row_slices
from lexmill.functions.tokens import SPECIAL_TOKENS, UNK_ID, byte_alphabet, text_of_symbols, words_to_encode
from lexmill.operators.bpe import Tokenizer

# A vocabulary is a broadcast value; anything larger than this is not one.
MAX_VOCABULARY = 1_000_000

# A task's arrays hold the ids of at most so many words, or of one text.
SLICE_WORDS = 1 << 19


def vocabulary_of(vocab: DataFrame) -> list[str]:
    """Tokens by id, brought to the driver after a check of their number."""
    size = vocab.count()
    if size > MAX_VOCABULARY:
        raise ValueError(f"{size} tokens exceed the vocabulary bound of {MAX_VOCABULARY}")
    return [row["token"] for row in vocab.orderBy("id").collect()]


def _join_table(merges: DataFrame) -> tuple:
    if merges.count() > 2 * MAX_VOCABULARY:
        raise ValueError("more merges than a bounded vocabulary can have")
    rows = merges.orderBy("rank").select("left_id", "right_id", "new_id").collect()
    return join_table([tuple(row) for row in rows])


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column; a narrow operation.

    The JVM splits the text into words. A task goes through an Arrow batch in slices
    of ``SLICE_WORDS`` words, which bounds its arrays; it joins each distinct word of
    a slice once, all words together, and gathers ids by position.
    """
    known = {token: token_id for token_id, token in enumerate(vocabulary_of(tokenizer.vocab))}
    letters = np.array([known.get(char, UNK_ID) for char in byte_alphabet()], np.int32)
    specials = SPECIAL_TOKENS
    shared = df.sparkSession.sparkContext.broadcast((letters, _join_table(tokenizer.merges)))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, table = shared.value
        for batch in (part for whole in batches for part in row_slices(whole, SLICE_WORDS)):
            words = batch.flatten().dictionary_encode()
            distinct = words.dictionary.cast(pa.large_binary())
            data = b"".join(distinct.to_pylist())
            sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
            pool, lengths = join_words(letters[np.frombuffer(data, np.uint8)], sizes, table)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            special = pc.index_in(words.dictionary, pa.array(specials)).to_numpy(zero_copy_only=False)
            for at in np.flatnonzero(~np.isnan(special)):
                # The bytes of a literal special token give way to its one id.
                pool[starts[at]] = special[at]
                lengths[at] = 1
            used = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(lengths[used])))
            values = pool[np.arange(ends[-1]) + np.repeat(starts[used] - ends[:-1], lengths[used])]
            counts = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
            yield pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(values, pa.int32()), mask=batch.is_null() if batch.null_count else None
            )

    # Not marked deterministic: a filter on the ids would otherwise encode twice.
    return df.withColumn(ids, ids_of.asNondeterministic()(words_to_encode(text)))


def tokens_of(ids, vocab: DataFrame) -> Column:
    """The token strings of an id array; the vocabulary is a plan constant."""
    listed = F.from_json(F.lit(json.dumps(vocabulary_of(vocab))), "array<string>")
    return F.transform(_col(ids), lambda token_id: F.try_element_at(listed, token_id + 1))


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of an id array; special tokens are left out."""
    regular = F.filter(_col(ids), lambda token_id: token_id >= len(SPECIAL_TOKENS))
    return df.withColumn(decoded, text_of_symbols(F.array_join(tokens_of(regular, vocab), "")))


def explode_tokens(df: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """One row per token: the other columns, 1-based ``pos``, ``token``, ``id``."""
    return explode_zipped(df.withColumn("tokens", tokens_of(ids, vocab)), "tokens", ids)


def explode_zipped(df: DataFrame, tokens: str, ids: str) -> DataFrame:
    kept = [name for name in df.columns if name not in (tokens, ids)]
    pairs = F.zip_with(tokens, ids, lambda token, token_id: F.struct(token.alias("token"), token_id.alias("id")))
    return df.select(*kept, F.posexplode(pairs).alias("_at", "_pair")).select(
        *kept, (F.col("_at") + 1).alias("pos"), "_pair.token", "_pair.id"
    )


def token_stats(df: DataFrame, vocab: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add token count, vocabulary size and characters per token (NULL without tokens)."""
    count = F.size(ids)
    return (
        df.withColumn("token_count", count)
        .withColumn("vocab_size", F.lit(vocab.count()))
        .withColumn("chars_per_token", F.when(count > 0, F.length(text) / count))
    )


def roundtrip_ok(df: DataFrame, text: str = "text", decoded: str = "decoded") -> DataFrame:
    """Flag rows whose lower-cased text contains the decoded text or the reverse."""
    lowered = F.lower(text)
    return df.withColumn("roundtrip_ok", F.contains(lowered, F.col(decoded)) | F.contains(F.col(decoded), lowered))
