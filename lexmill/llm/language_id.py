"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter n-grams (1 to 3 bytes of the lower-cased
letters, runs of other characters count as one blank), weighted by TF-IDF and
normalised. Each language's sample vectors are clustered into a few centroids
by spherical k-means; a text gets the language of the centroid with the largest
cosine. It counts as rejected if that cosine is below what nearly all sample
texts of the cluster reach.

Texts without letters, empty and null texts get ``und``, score 0, rejected.
Ties go to the language that comes first in order of its name. Rows are kept
as they are, repeated ones too. Whole texts are counted, slice by slice.
"""

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.sampling import sample_frame
from lexmill.llm.texts import slices, stored, text_bytes

UNKNOWN = "und"
BUCKETS = 2048
#: More values than there are languages; such a column holds something else.
MAX_LANGUAGES = 10_000


class Centroids(NamedTuple):
    """A fitted model; ``languages[i]``, ``nearest[i]`` belong to row i of ``centres``."""

    languages: list[str]
    centres: np.ndarray
    idf: np.ndarray
    nearest: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray | None]:
    """For each text the counts of its hashed n-grams, or None without letters; ``data`` is lower-cased UTF-8."""
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    symbol = np.where(letter, data, 32).astype(np.uint32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = symbol[a:b]
        inside = letter[a:b]
        if not inside.any():
            yield None
            continue
        blank = own == 32
        keep = np.ones(len(own), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        own = np.concatenate([[32], own[keep], [32]]).astype(np.uint32)
        one, two = own[1:-1], own[:-1] * np.uint32(257) + own[1:]
        three = two[:-1] * np.uint32(263) + own[2:]
        keys = np.concatenate([one[one != 32], two, three]) * np.uint32(2654435761)
        yield np.bincount(keys >> np.uint32(21), minlength=BUCKETS)


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.lower() for t in column.to_pylist()], pa.large_string())


def vectors(column: pa.Array, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One normalised vector per text, and which texts have letters; raw log counts without ``idf``."""
    texts = lowered(column)
    data, offsets = text_bytes(texts)
    out = np.zeros((len(column), BUCKETS), np.float32)
    has = np.zeros(len(column), bool)
    for i, counts in enumerate(grams(data, offsets)):
        if counts is not None and any(map(str.isalpha, texts[i].as_py())):
            has[i] = True
            out[i] = np.log1p(counts)
    if idf is not None:
        out *= idf
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, has


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are the rows farthest from those before."""
    centres = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        near = np.max(rows @ np.array(centres).T, axis=1)
        centres.append(rows[int(np.argmin(near))])
    centres = np.array(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = np.argmax(rows @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = rows[own == j].mean(axis=0)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def sampled(labelled: DataFrame, key: str, lang: str, per_language: int) -> list[tuple]:
    """Up to ``per_language`` keys of every language with the language, drawn by the hash of the key, so the same rows each time."""
    known = labelled.where(F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN))
    languages = known.select(lang).distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}: not language labels")
    drawn = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k")
    rows = known.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("label")).distinct()
    return [(r["k"], r["label"]) for r in rows.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= per_language).collect()]


def inverse_frequencies(texts: DataFrame, text: str) -> np.ndarray:
    """The IDF of every bucket over all texts with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                for at in range(0, part.num_rows, 1024):
                    rows, has = vectors(part.slice(at, 1024).column(text))
                    total[:-1] += (rows > 0).sum(axis=0)
                    total[-1] += has.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS + 1), pa.int64()), pa.array(total)], ["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)


def fit(labelled: DataFrame, *, key: str, text: str, lang: str, per_language: int = 300, clusters: int = 4, reject_share: float = 0.005) -> Centroids:
    """Fit on at most ``per_language`` texts of every language; document frequencies are counted over all rows of ``labelled``.

    ``reject_share`` is the share of a cluster's sample texts that its distance limit rejects.
    """
    found = sampled(labelled, key, lang, per_language)
    none = Centroids([], np.zeros((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.zeros(0, np.float32))
    if not found:
        return none
    sample = sample_frame(labelled.select(F.col(key), F.col(text)), found, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows, has = vectors(part.column(text))
                for i in np.flatnonzero(has):
                    yield pa.RecordBatch.from_arrays([part.column("sample_label").slice(i, 1).cast(pa.string()), part.column(key).slice(i, 1).cast(pa.string()), pa.array([rows[i].astype(np.float16).tobytes()], pa.binary())], ["lang", "key", "vector"])

    rows = stored(sample.mapInArrow(run, "lang string, key string, vector binary"), "languages").orderBy("lang", "key", "vector")
    idf = inverse_frequencies(labelled, text)
    names, centres, nearest = [], [], []
    # One language's vectors at a time are on the driver.
    for language, group in itertools.groupby(rows.toLocalIterator(), key=lambda r: r["lang"]):
        own = np.array([np.frombuffer(r["vector"], np.float16) for r in group]).astype(np.float32) * idf
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        made = k_means(own, clusters)
        cosine = own @ made.T
        best = np.argmax(cosine, axis=1)
        for j, centre in enumerate(made):
            near = cosine[best == j, j]
            if len(near):
                names.append(language)
                centres.append(centre)
                nearest.append(np.quantile(near, reject_share))
    return none if not names else Centroids(names, np.array(centres, np.float32), idf, np.array(nearest, np.float32))


def predict(df: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``; narrow. The text column is dropped."""
    kept = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, centres, idf, nearest = shared.value
        for batch in batches:
            for part in slices(batch, text):
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    rows, has = vectors(some.column(text), idf)
                    if languages:
                        cosine = np.clip(rows @ centres.T, 0.0, 1.0)
                        best = np.argmax(cosine, axis=1)
                        score = np.where(has, cosine[np.arange(len(best)), best], 0.0).astype(np.float64)
                        names = [languages[j] if ok else UNKNOWN for j, ok in zip(best, has, strict=True)]
                        rejected = ~has | (score < nearest[best])
                    else:
                        score, names, rejected = np.zeros(len(has)), [UNKNOWN] * len(has), np.ones(len(has), bool)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*kept, "lang_pred", "score", "rejected"])

    return df.mapInArrow(run, schema)
