"""Removal of long passages that repeat across documents, by repeated-phrase automata.

A window is ``window`` consecutive words of one document. Each window is marked
by the phrase in it (``PHRASE`` consecutive words) with the smallest hash, so
equal windows have equal phrases, and a document has one phrase for some twenty
windows. The method:

1. Documents of equal word sequences are found by digest. All but those of the
   smallest id lose every word (or none, if shorter than a window); only the
   former go on.
2. Phrases that mark windows in two documents at least are recurring.
3. The recurring phrases of a shard of documents are compiled to an Aho-Corasick
   automaton over words, and every document of the shard that has one streams
   through it. Windows whose phrase it locates are candidates.
4. Candidates are confirmed by the hash of all their words: the smallest id with
   that window owns it, and every other document loses its words.

Every grouping is by a hash and pre-aggregated; no group of documents meets in
one task. Null texts have no words. A null id is smaller than none: such
documents lose nothing, and nobody loses to them. Rows that share an id do not
lose to each other; repeated rows get equal results.
"""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.texts import SPACE, list_array, run_hashes, slices, stored, text_bytes, within, word_bounds, word_hashes

PHRASE = 8


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """The smallest of each ``length`` consecutive values."""
    if len(values) < length:
        return values[:0]
    width = 1
    while 2 * width <= length:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = length - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def marks(words: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the phrase from each word, the smallest one of the window from each word, and whether that window is in one text."""
    phrases = run_hashes(words, PHRASE)
    smallest = sliding_min(phrases, window - PHRASE + 1)
    return phrases, smallest, within(firsts, window)[: len(smallest)]


def digests(df: DataFrame, window: int) -> DataFrame:
    """``id, tk`` of each row with the number and digest of its words and the phrases that mark its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                data, offsets = text_bytes(part.column("source"))
                starts, ends, firsts = word_bounds(~SPACE[data], offsets)
                _, smallest, inside = marks(word_hashes(data, starts, ends), firsts, window)
                at = np.flatnonzero(inside)
                value = smallest[at]
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
                bounds = np.searchsorted(at[new], firsts)
                whole = data.tobytes()
                sha = [hashlib.sha256(b" ".join(whole[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tk"), pa.array(np.diff(firsts), pa.int64()), pa.array(sha, pa.binary()), list_array(value[new].view(np.int64), bounds, pa.int64())],
                    ["id", "tk", "n_words", "sha", "phrases"],
                )

    return df.mapInArrow(run, "id long, tk long, n_words long, sha binary, phrases array<long>")


def candidates(df: DataFrame, window: int) -> DataFrame:
    """``id, tk, source`` and the runs of candidate windows of each row, located by the automaton of its batch."""

    def located(words: np.ndarray, firsts: np.ndarray, phrases: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Positions at which a phrase of ``wanted`` begins, found by streaming the words of each text through one automaton."""
        symbol = (words >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.isin(phrases, wanted))
        _, once = np.unique(phrases[first], return_index=True)
        if not len(once):
            return np.zeros(0, np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in first[once].tolist():
            automaton.add_word(tuple(symbol[p : p + PHRASE].tolist()), 1)
        automaton.make_automaton()
        found = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= window:
                found += [a + end - PHRASE + 1 for end, _ in automaton.iter(tuple(symbol[a:b].tolist()))]
        return np.array(found, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                data, offsets = text_bytes(part.column("source"))
                starts, ends, firsts = word_bounds(~SPACE[data], offsets)
                words = word_hashes(data, starts, ends)
                phrases, smallest, inside = marks(words, firsts, window)
                wanted = part.column("phrases").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                hits = located(words, firsts, phrases, np.unique(wanted))
                only = np.full(len(phrases), np.iinfo(np.uint64).max, np.uint64)
                only[hits] = phrases[hits]
                good = inside & (sliding_min(only, window - PHRASE + 1) == smallest)
                edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                text = np.searchsorted(firsts, begin, "right") - 1
                keep = np.bincount(text, minlength=part.num_rows) > 0
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                base = firsts[text]
                runs = [list_array(x, bounds, pa.int32()) for x in (begin - base, end - base)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tk"), part.column("source"), *runs], ["id", "tk", "source", "begin", "until"]).filter(pa.array(keep))

    return df.mapInArrow(run, "id long, tk long, source string, begin array<int>, until array<int>")


def window_rows(df: DataFrame, window: int) -> DataFrame:
    """One row for each candidate window: its hash, the row that has it, and its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source", 1 << 19):
                data, offsets = text_bytes(part.column("source"))
                starts, ends, firsts = word_bounds(~SPACE[data], offsets)
                hashes = run_hashes(word_hashes(data, starts, ends), window)
                begin, until = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin", "until"))
                runs = np.array(part.column("begin").value_lengths())
                text = np.repeat(np.arange(part.num_rows), runs)
                size = until - begin
                row = np.repeat(text, size)
                start = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                value = hashes[firsts[row] + start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), part.column("id").take(pa.array(row)), part.column("tk").take(pa.array(row)), pa.array(start.astype(np.int32))], ["h", "id", "tk", "start"]
                )

    return df.mapInArrow(run, "h long, id long, tk long, start int")


def cut(df: DataFrame, window: int) -> DataFrame:
    """Rows with ``removed`` (first words of windows) to what is left: counts, digest, and the text with removed words cut out.

    Words that stay side by side keep the white space between them; where words were cut there is one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                data, offsets = text_bytes(part.column("source"))
                starts, ends, firsts = word_bounds(~SPACE[data], offsets)
                whole = data.tobytes()
                n_removed, sha, texts = [], [], []
                for i, removed in enumerate(part.column("removed")):
                    a, b = firsts[i], firsts[i + 1]
                    at = np.array(removed.values)
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + window, b - a), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    n_removed.append(int((~keep).sum()))
                    step = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
                    pieces = [whole[starts[a + u] : ends[a + v - 1]] for u, v in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
                    texts.append(b" ".join(pieces).decode())
                    sha.append(hashlib.sha256(b" ".join(b" ".join(pieces).split())).digest())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tk"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(texts, pa.string())], ["id", "tk", "n_removed", "sha_left", "text_left"])

    return df.mapInArrow(run, "id long, tk long, n_removed long, sha_left binary, text_left string")


def passages(df: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """All rows' digests with ``copy`` (an equal word sequence has a smaller id), and the rows that lose passages with what is left of them.

    Both are keyed by ``id`` and ``tk``, a hash of the text.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tk"), F.col(text).alias("source"))
    found = stored(digests(rows, window), "digests")
    # What is joined back is written first: a frequent key's rows can then be split on the other side.
    first = stored(found.where(F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "copies")
    found = found.join(first, "sha", "left").withColumn("copy", F.coalesce((F.col("id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False)))
    one = found.where(~F.col("copy") & F.col("id").isNotNull()).select("id", "tk", F.explode("phrases").alias("phrase"))
    recurring = stored(one.groupBy("phrase").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("phrase"), "recurring")
    lists = one.join(recurring, "phrase").groupBy("id", "tk").agg(F.collect_set("phrase").alias("phrases"))
    some = stored(candidates(rows.join(lists, ["id", "tk"]), window), "candidates")
    windows = window_rows(some, window)
    owned = stored(windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "lo"), "owned")
    removed = windows.join(owned, "h").where("id > lo").groupBy("id", "tk").agg(F.collect_set("start").alias("removed"))
    return found, cut(some.dropDuplicates(["id", "tk"]).join(removed, ["id", "tk"]), window)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 50) -> DataFrame:
    """Per row the key, ``n_words``, ``n_removed`` and the digest of the words that stay, joined by one space."""
    found, left = passages(df, key, text, window=window)
    empty = F.sha2(F.lit(b""), 256)
    joined = found.join(left.drop("text_left"), ["id", "tk"], "left")
    kept = F.when(F.col("copy"), empty).otherwise(F.lower(F.hex(F.coalesce("sha_left", "sha"))))
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return joined.select(F.col("id").alias(key), "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 50) -> DataFrame:
    """The rows with what is left of their texts; rows that lost every word go. Other columns stay as they are."""
    found, left = passages(df, key, text, window=window)
    gone = found.where("copy").select("id", "tk").distinct().withColumn("_gone", F.lit(True))
    own = df.withColumn("_id", F.col(key).cast("long")).withColumn("_tk", F.xxhash64(text))
    rest = left.select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), F.col("text_left").alias("_left"))
    joined = own.join(rest, ["_id", "_tk"], "left").join(gone.select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), "_gone"), ["_id", "_tk"], "left")
    joined = joined.where(F.col("_gone").isNull() & (F.col("_left").isNull() | (F.col("_left") != "")))
    return joined.select(*[F.coalesce("_left", F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns])
