"""Byte-pair vocabulary training as rounds of Spark aggregations.

One Spark job per merge would need tens of thousands of jobs, so every round
settles many merges at once and still gives the one-at-a-time result:

1. Spark keeps the counts of all adjacent pairs and returns the most frequent ones, at most
   a few thousand: the round's *frequent* pairs and the best pair left out.
2. Spark cuts every word wherever two neighbours are not a frequent pair and
   sums the remaining fragments. A pair across a cut can never become more
   frequent than the best pair left out, because merging only makes rarer pairs.
   So the fragments hold all that decides the merges above that count.
3. The driver replays merges on this bounded digest until the best count falls
   to what was left out. A digest over its row limit is never fetched: the round
   is repeated with fewer frequent pairs, down to a single pair, which needs none.
4. Spark applies the settled merges to the words that hold one and marks these; only
   the marked words are counted again, as signed differences that are added to the counts.

Fragments and pairs stay small whatever the corpus size; words, pair counts and
fragment sums are distributed throughout.
"""

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.joins import (
    counted_pairs, cut_words, join_table, join_words, pair_keys, symbol, symbol_id, symbols_of, words_holding, words_of_symbols
)
from lexmill.functions.tokens import SPECIAL_TOKENS
from lexmill.operators.vocabulary import init_vocab, symbol_words, word_counts
from lexmill.session import written
from lexmill.sources.tables import spread

VOCAB_SIZE = 32_000
MIN_FREQUENCY = 2

VOCAB_SCHEMA = "id int, token string"
MERGES_SCHEMA = "rank int, left_id int, right_id int, new_id int"

# The driver never fetches a digest of more symbols than this.
MAX_DIGEST_SYMBOLS = 5_000_000

# Lineage is cut by writing words and counts after this many rounds.
ROUNDS_TO_WRITE = 8

_STATE_SCHEMA = "word string, cnt bigint, before string"


@dataclass(frozen=True)
class Tokenizer:
    """A trained vocabulary: ``vocab(id, token)`` and ``merges(rank, left_id, right_id, new_id)``."""

    vocab: DataFrame
    merges: DataFrame


def apply_merges(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Join the pairs, in order, in every word that holds one: ``word, cnt, before``.

    ``before`` is the word as it was where it changed, and null elsewhere: the marks
    from which ``count_changes`` works. A word of one symbol is done; it stays for
    the round that made it, so that its last pair is taken off the counts.
    """
    table = join_table([(symbol_id(pair[0]), symbol_id(pair[1]), symbol_id(joint)) for pair, joint in merges])
    starts = pair_keys([pair for pair, _ in merges])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word")
            # A word changes if it holds a pair at the start; later pairs arise from such a one.
            held = words_holding(word, starts)
            mask = pa.array(held)
            changed = words_of_symbols(*join_words(*symbols_of(word.filter(mask)), table, ascending=True))
            before = pc.if_else(mask, word, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pc.replace_with_mask(word, mask, changed), batch.column("cnt"), before], names=["word", "cnt", "before"]
            )

    return words.filter(F.length("word") > 1).select("word", "cnt").mapInArrow(joined, _STATE_SCHEMA)


def _summed(words: DataFrame, counted) -> DataFrame:
    """Pairs that tasks have counted batch by batch, added up: ``pair, cnt``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, sums in counted(batch):
                yield pa.RecordBatch.from_arrays([pairs, pa.array(sums, pa.int64())], names=["pair", "cnt"])

    return words.mapInArrow(partial, "pair string, cnt bigint").groupBy("pair").agg(F.sum("cnt").alias("cnt"))


def count_pairs(words: DataFrame) -> DataFrame:
    """All adjacent pairs of all words."""
    return _summed(words.select("word", "cnt"), lambda batch: [counted_pairs(batch.column("word"), batch.column("cnt").to_numpy())])


def count_changes(words: DataFrame) -> DataFrame:
    """Signed differences of the pair counts: what the words that changed gained, less what they had before."""

    def signed(batch: pa.RecordBatch) -> list:
        cnt = batch.column("cnt").to_numpy()
        return [counted_pairs(batch.column("word"), cnt), counted_pairs(batch.column("before"), -cnt)]

    return _summed(words.filter("before is not null").select("word", "cnt", "before"), signed)


def fragments(words: DataFrame, frequent: list[str]) -> DataFrame:
    """Runs of symbols joined by frequent pairs, with summed counts."""
    known = pair_keys(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, weights = cut_words(batch.column("word"), batch.column("cnt").to_numpy(), known)
            yield pa.RecordBatch.from_arrays([runs, pa.array(weights, pa.int64())], names=["word", "cnt"])

    return words.select("word", "cnt").mapInArrow(cut, "word string, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def replay(digest, outside, min_frequency, tokens, room):
    """Merges that the digest settles, in order, as ``(pair, new symbol)``.

    ``outside`` is the best pair the digest does not show, with its count. Ties
    go to the smaller ids; new symbols have the largest ids of all, so a pair
    that sorts before ``outside`` also sorts before whatever grows out of it.
    """
    limit, limit_pair = outside
    counts, holders = Counter(), defaultdict(set)
    for word, cnt in digest.items():
        for pair in map("".join, zip(word, word[1:])):
            counts[pair] += cnt
            holders[pair].add(word)
    weights, settled = Counter(digest), []
    ids = {token: symbol(token_id) for token_id, token in enumerate(tokens)}
    queue = [(-cnt, pair) for pair, cnt in counts.items()]
    heapq.heapify(queue)
    while queue and len(tokens) < room:
        negative, pair = heapq.heappop(queue)
        if -negative != counts[pair]:
            continue  # an outdated entry; the pair was queued again when it changed
        if -negative < max(min_frequency, limit) or (-negative == limit and pair >= limit_pair):
            break
        token = tokens[symbol_id(pair[0])] + tokens[symbol_id(pair[1])]
        repeated = token in ids
        if not repeated:
            ids[token] = symbol(len(tokens))
            tokens.append(token)
        joint = ids[token]
        settled.append((pair, joint))
        if repeated:
            break  # an old symbol gains neighbours the digest does not show
        touched = set()
        for word in holders.pop(pair):
            cnt, merged = weights.pop(word), word.replace(pair, joint)
            weights[merged] += cnt
            for near in map("".join, zip(word, word[1:])):
                counts[near] -= cnt
                holders[near].discard(word)
                touched.add(near)
            for near in map("".join, zip(merged, merged[1:])):
                counts[near] += cnt
                holders[near].add(merged)
                touched.add(near)
        for near in touched:
            if counts[near] > 0:
                heapq.heappush(queue, (-counts[near], near))
    return settled


def most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """The first pairs by count, in order, in one partition.

    Collecting an ordered limit itself would send the first rows of every partition
    to the driver. Below ``coalesce`` a task reduces them, and only ``rows`` are sent.
    """
    return counts.orderBy(F.desc("cnt"), "pair").limit(rows).coalesce(1)


def fetch_digest(words: DataFrame, frequent: list[str], longest: int, max_rows: int) -> dict | None:
    """The fragments and their counts, or None if there are too many to fetch.

    Words of ordinary length bound the size through the row limit. Where some
    word is extremely long, the symbols are summed before anything is fetched.
    """
    found = fragments(words, frequent)
    if max_rows * longest > MAX_DIGEST_SYMBOLS:
        size = found.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("symbols")).first()
        if size["rows"] > max_rows or (size["symbols"] or 0) > MAX_DIGEST_SYMBOLS:
            return None
    rows = found.limit(max_rows + 1).collect()
    return {row["word"]: row["cnt"] for row in rows} if len(rows) <= max_rows else None


def train_bpe(
    df: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    text: str = "text",
    frequent_pairs: int = 2048,
    digest_rows: int = 20_000,
) -> Tokenizer:
    """Learn a byte-pair vocabulary from a text column.

    ``frequent_pairs`` and ``digest_rows`` bound what the driver sees per round;
    they change the number of rounds, never the result.
    """
    spark = df.sparkSession
    words = written(symbol_words(word_counts(df, text)), "bpe-words")
    tokens = [row["token"] for row in init_vocab(words).orderBy("id").collect()]
    letters = tokens[len(SPECIAL_TOKENS):]
    coded = F.translate("word", "".join(letters), "".join(symbol(tokens.index(letter)) for letter in letters))
    state = words.select(coded.alias("word"), "cnt", F.lit(None).cast("string").alias("before")).filter(F.length("word") > 1)
    # Counted words are few bytes for the work they make: all cores shall have some.
    state = written(spread(state), "bpe-words")
    counts = written(count_pairs(state), "bpe-pairs")

    # Cached sums keep the session's number of shuffle partitions, each a task in every round: as many as the words have are enough.
    parts = state.rdd.getNumPartitions()

    longest = state.agg(F.max(F.length("word"))).first()[0] or 0

    merges, width, rounds, replaced = [], min(32, frequent_pairs), 0, []
    while len(tokens) < vocab_size:
        top = most_frequent(counts.filter(F.col("cnt") >= min_frequency), frequent_pairs + 1).collect()
        while replaced:
            for table in replaced.pop():
                table.unpersist()
        if not top:
            break
        digest = None
        while digest is None:
            frequent = [row["pair"] for row in top[:width]]
            outside = (top[width]["cnt"], top[width]["pair"]) if width < len(top) else (0, "")
            if width == 1:
                digest = {frequent[0]: top[0]["cnt"]}
            else:
                digest = fetch_digest(state, frequent, longest, digest_rows)
                width = width if digest is not None else width // 2
        settled = replay(digest, outside, min_frequency, tokens, vocab_size)
        merges += settled
        if len(tokens) < vocab_size:
            # Only words that changed are counted again, and their old pairs taken off. Both tables stay in memory
            # or on disk until the next round has read them; what is lost is made again from the last written round.
            changed = apply_merges(state, settled).persist()
            added = counts.unionByName(count_changes(changed)).repartition(parts, "pair").groupBy("pair").agg(F.sum("cnt").alias("cnt"))
            replaced.append((state, counts))
            state, counts = changed, added.filter("cnt > 0").persist()
            rounds += 1
            if rounds % ROUNDS_TO_WRITE == 0:
                replaced.append((state, counts))
                state, counts = written(state, "bpe-words"), written(counts, "bpe-pairs")
        # A digest far below its limit leaves room for more pairs per round.
        growth = 4 if len(digest) * 16 < digest_rows else 2 if len(digest) * 4 < digest_rows else 1
        width = min(growth * width, frequent_pairs)

    state.unpersist()
    counts.unpersist()
    return Tokenizer(
        vocab=spark.createDataFrame(list(enumerate(tokens)), VOCAB_SCHEMA),
        merges=spark.createDataFrame(
            [
                (rank, symbol_id(pair[0]), symbol_id(pair[1]), symbol_id(joint))
                for rank, (pair, joint) in enumerate(merges)
            ],
            MERGES_SCHEMA,
        ),
    )
