"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max bounds, then verified.

Every training text is cut into overlapping passages, twice as long as the
longest item, so that any copy of an item lies whole in one of them. A passage's
distinct words are a query; an item's score is its BM25 score as a share of the
score that the item itself gets. Items are indexed in blocks with the largest
weight of each word per block. Frequent words, whose weights together stay under
half the threshold, only ever add a constant to a bound; the bounds of all
blocks come from the other words, and only items in blocks that can reach the
threshold are scored. All items over the threshold are retrieved, without a cap.

A retrieved item is verified: of its question (what stands before its last
sentence) and of its answer (the last sentence, or the last quarter if there is
only one) enough runs of five words must be in the passage.

Words are the lower-cased runs of letters, digits and bytes beyond ASCII. Null
and empty texts and items match nothing. Equal items are reported each. Items
are collected in shards of ``SHARD`` rows, so what is broadcast is bounded.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.language_id import lowered
from lexmill.llm.texts import LETTERS, run_hashes, slices, text_bytes, word_bounds, word_hashes

SHARD, SHARD_BYTES = 20_000, 64 << 20
BLOCK = 8
RUN = 5
K1, B = 1.2, 0.75
WORD = LETTERS.copy()
WORD[ord("0") : ord("9") + 1] = True


class Index(NamedTuple):
    """Item ids and their question and answer runs; terms with postings by item and, for the rare ones, by block; each item's
    terms, and what its frequent ones can add at most (``rest``)."""

    ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    item_begin: np.ndarray
    item_terms: np.ndarray
    item_weight: np.ndarray
    rare: np.ndarray
    block_begin: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    rest: np.ndarray
    passage: int


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each text's first word, and the bytes with the words' ends, for sentence marks."""
    data, offsets = text_bytes(lowered(column))
    starts, ends, firsts = word_bounds(WORD[data], offsets)
    return word_hashes(data, starts, ends), firsts, data, ends


def parts_of(words: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of an item's question and of its answer; ``stops`` are words that end a sentence."""
    inner = stops[(stops >= 1) & (stops < len(words) - 1)]
    at = int(inner[-1]) + 1 if len(inner) else max(len(words) - max(len(words) // 4, 1), 0)
    question, answer = (words[:at], words[at:]) if 0 < at < len(words) else (words, words)
    return tuple(np.unique(run_hashes(part, RUN) if len(part) >= RUN else run_hashes(part, len(part)) ^ np.uint64(len(part) % RUN)) for part in (question, answer))


def build(ids: list, texts: list[str | None], threshold: float) -> Index:
    words, firsts, data, ends = tokens(pa.array(texts, pa.string()))
    n = len(ids)
    sizes = np.diff(firsts)
    questions, answers = [], []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        # A word ends a sentence if one of . ? ! or a line end stands between it and the next.
        stops = [i - a for i in range(a, b - 1) if set(data[ends[i] : ends[i] + 2].tolist()) & {46, 63, 33, 10}]
        q, r = parts_of(words[a:b], np.array(stops, np.int64)) if b > a else (np.zeros(0, np.uint64),) * 2
        questions.append(q)
        answers.append(r)
    terms, term = np.unique(words, return_inverse=True)
    item = np.repeat(np.arange(n), sizes)
    keys, tf = np.unique(term * max(n, 1) + item, return_counts=True)
    term, item = keys // max(n, 1), keys % max(n, 1)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = max(sizes.mean(), 1) if n else 1
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / mean))
    weight /= np.maximum(np.bincount(item, weight, n), 1e-12)[item]
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    largest = np.zeros(len(terms))
    np.maximum.at(largest, term, weight)
    order = np.argsort(-df, kind="stable")
    frequent = order[: np.searchsorted(np.cumsum(largest[order]), threshold / 2)]
    rare = np.ones(len(terms), bool)
    rare[frequent] = False
    some = rare[term]
    block_keys, which = np.unique(term[some] * (n // BLOCK + 1) + item[some] // BLOCK, return_inverse=True)
    bound = np.zeros(len(block_keys))
    np.maximum.at(bound, which, weight[some])
    block_term = block_keys // (n // BLOCK + 1)
    by_item = np.lexsort((term, item))
    return Index(
        ids, questions, answers, terms, begin, item, weight, np.searchsorted(item[by_item], np.arange(n + 1)), term[by_item], weight[by_item], rare,
        np.searchsorted(block_term, np.arange(len(terms) + 1)), block_keys % (n // BLOCK + 1), bound, np.bincount(item[~some], weight[~some], n), 2 * max(int(sizes.max(initial=1)), RUN),
    )


def expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of the range, and the position, of all their elements."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def search(index: Index, words: np.ndarray, firsts: np.ndarray, threshold: float, may: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Text, first word of a passage in it, item and score of all items over the threshold, for all texts at once.

    ``may`` sorts out most words by their low bits. Bounds of blocks come first,
    then the rare words' part of the scores in blocks that pass, then whole scores.
    """
    n_terms, n_items = len(index.terms), len(index.ids)
    if not n_terms:
        return
    step, blocks = index.passage // 2, n_items // BLOCK + 1
    sizes = np.diff(firsts)
    counts = np.where(sizes > 0, np.maximum((sizes - 1) // step, 1), 0)
    base = np.cumsum(counts) - counts
    at = np.flatnonzero(may[(words & np.uint64(0xFFFF)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.terms, words[at]), n_terms - 1)
    hit = index.terms[term] == words[at]
    at, term = at[hit], term[hit]
    text = np.searchsorted(firsts, at, "right") - 1
    own = (at - firsts[text]) // step
    # A word is in the passage that begins in its step and in the one before.
    here, before = own < counts[text], own > 0
    own += base[text]
    keys = np.unique(np.concatenate([own[here] * n_terms + term[here], (own[before] - 1) * n_terms + term[before]]))
    passage, word = keys // n_terms, keys % n_terms
    group = max(1, (1 << 22) // n_items)
    for low in range(0, int(counts.sum()), group):
        high = min(low + group, int(counts.sum()))
        u, v = np.searchsorted(passage, [low, high])
        local, used = passage[u:v] - low, word[u:v]
        which, place = expand(index.block_begin[used], index.block_begin[used + 1])
        bounds = np.bincount(local[which] * blocks + index.block[place], index.bound[place], (high - low) * blocks)
        good = bounds >= threshold - index.rest.max(initial=0) - 1e-9
        some = good.reshape(-1, blocks).any(axis=1)[local] & index.rare[used]
        local_some, used_some = local[some], used[some]
        which, place = expand(index.begin[used_some], index.begin[used_some + 1])
        inside = good[local_some[which] * blocks + index.item[place] // BLOCK]
        which, place = which[inside], place[inside]
        scores = np.bincount(local_some[which] * n_items + index.item[place], index.weight[place], (high - low) * n_items)
        for key in np.flatnonzero(scores >= threshold - np.tile(index.rest, high - low) - 1e-9).tolist():
            p, i = key // n_items, key % n_items
            a, b = np.searchsorted(local, [p, p + 1])
            c, d = index.item_begin[i], index.item_begin[i + 1]
            score = float(index.item_weight[c:d][np.isin(index.item_terms[c:d], used[a:b])].sum())
            if score >= threshold - 1e-9:
                t = int(np.searchsorted(base + counts, low + p, "right"))
                yield t, (low + p - int(base[t])) * step, i, score


def matches(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, least_overlap: float = 0.5) -> DataFrame:
    """Contaminated documents: one row per document row and item, with the best passage and both overlaps. Narrow, one pass per shard of items."""
    spark = documents.sparkSession
    known = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    sizes = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size")).first()
    shards = max(1, -(-sizes["n"] // SHARD), -(-(sizes["size"] or 0) // SHARD_BYTES))
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("source"))
    found = None
    for shard in range(shards):
        own = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard).collect()
        own.sort(key=lambda r: (r["i"], r["t"]))
        more = in_shard(rows, build([r["i"] for r in own], [r["t"] for r in own], threshold), threshold, least_overlap)
        found = more if found is None else found.union(more)
    return found.select(F.col("id").alias(key), F.col("item").alias(item_key), "passage_start", "score", "question_overlap", "answer_overlap")


def in_shard(rows: DataFrame, index: Index, threshold: float, least_overlap: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    names = ["id", "item", "passage_start", "score", "question_overlap", "answer_overlap"]

    def verified(words: np.ndarray, firsts: np.ndarray, may: np.ndarray) -> list[tuple]:
        """Text, item and the best passage of each pair that both overlaps confirm."""
        index, best, last = shared.value, {}, None
        for text, start, item, value in search(index, words, firsts, threshold, may):
            if last != (text, start):
                last = (text, start)
                passage = words[firsts[text] + start : min(firsts[text] + start + index.passage, firsts[text + 1])]
                # Runs of five words, and shorter ones for items with shorter parts.
                runs = np.concatenate([run_hashes(passage, n) ^ np.uint64(n % RUN) for n in range(1, RUN + 1)])
            question, answer = (float(np.isin(r, runs).mean()) if len(r) else 0.0 for r in (index.questions[item], index.answers[item]))
            if min(question, answer) >= least_overlap and ((text, item) not in best or question + answer > sum(best[text, item][2:])):
                best[text, item] = (start, value, question, answer)
        return [(text, index.ids[item], *row) for (text, item), row in sorted(best.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.zeros(1 << 16, bool)
        may[(shared.value.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, "source"):
                words, firsts, _, _ = tokens(part.column("source"))
                ids = part.column("id").to_pylist()
                out = [(ids[text], *row) for text, *row in verified(words, firsts, may)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, "id long, item long, passage_start long, score double, question_overlap double, answer_overlap double")


def keep_clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The rows that match no item. The rows' key says which; rows without a key stay."""
    gone = matches(df, items, key=key, text=text, **options).select(F.col(key).alias("_id")).where("_id is not null").distinct()
    return df.join(gone, F.col(key).cast("long") == F.col("_id"), "left_anti")
