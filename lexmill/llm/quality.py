"""Quality by co-training of two classifiers with separate views of a document.

The content view sees the text alone: shares of kinds of characters, word and
line statistics, repetition, and hashed pairs of character classes. The metadata
view sees what stands beside it: source, language and length. Each is a logistic
regression, fitted on a bounded sample of labelled rows. Over a few rounds each
labels the rows of a bounded unlabelled sample of which it is most confident,
for the other one to learn from. Both are calibrated on labelled rows that they
were not fitted on, and a logistic regression combines the two log odds.

Null and empty texts have no content: all text statistics are 0, and what was
learnt decides as for any row. Null metadata is a value of its own. Repeated
rows get equal scores. Without labels of both classes every score is the share
of good labels (1 if there are none), so nothing is rejected for lack of data.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.sampling import sample_frame, sample_ids
from lexmill.llm.texts import slices, text_bytes, word_bounds, word_hashes

# Kinds of bytes: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 sentence mark, 6 other mark, 7 beyond ASCII.
KIND = np.full(256, 6, np.uint8)
KIND[[0x20, 0x09, 0x0B, 0x0C]] = 0
KIND[[0x0A, 0x0D]] = 1
KIND[ord("a") : ord("z") + 1] = 2
KIND[ord("A") : ord("Z") + 1] = 3
KIND[ord("0") : ord("9") + 1] = 4
KIND[[ord(c) for c in ".,;:'\"-()"]] = 5
KIND[128:] = 7
N_TEXT = 8 + 64 + 9
META_BUCKETS = 128


class Linear(NamedTuple):
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weight + self.bias


class Model(NamedTuple):
    content: Linear
    metadata: Linear
    combined: Linear


def content_features(column: pa.Array) -> np.ndarray:
    """One row per text, from all of it."""
    data, offsets = text_bytes(column)
    kind = KIND[data]
    starts, ends, firsts = word_bounds(kind > 1, offsets)
    hashes = word_hashes(data, starts, ends)
    lengths = ends - starts
    pair = kind[:-1].astype(np.int64) * 8 + kind[1:] if len(kind) else np.zeros(0, np.int64)
    out = np.zeros((len(column), N_TEXT))
    for i, (a, b, u, v) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        n, words = b - a, v - u
        if not words:
            continue
        h, size = hashes[u:v], lengths[u:v]
        out[i, :8] = np.bincount(kind[a:b], minlength=8) / n
        out[i, 8:72] = np.sqrt(np.bincount(pair[a : b - 1], minlength=64) / n)
        same = float((h[1:] == h[:-1]).mean()) if words > 1 else 0.0
        two = len(np.unique(h[1:] * np.uint64(31) + h[:-1])) / (words - 1) if words > 1 else 1.0
        short = kind[starts[u:v]]
        out[i, 72:] = (size.mean() / 10, size.std() / 10, (size >= 20).mean(), (size <= 2).mean(), same, len(np.unique(h)) / words, two, (short == 6).mean(), (short == 3).mean())
    return out


def metadata_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source, language and both together, and the length as a number and in steps."""
    out = np.zeros((len(source), META_BUCKETS + 2))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        step = -1 if n is None else int(max(n, 0)).bit_length()
        for j, value in enumerate((f"s{s!r}", f"g{g!r}", f"n{step}", f"{s!r}/{g!r}")):
            key = sum((k + 1) * c for k, c in enumerate(value.encode())) * 2654435761 % (1 << 32)
            out[i, (key >> 16) % META_BUCKETS] += 1.0 if j < 3 else 0.5
        out[i, -2:] = (n is None, np.log1p(max(n or 0, 0)))
    return out


def logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float) -> Linear:
    """Newton's method with a ridge penalty on standardised columns."""
    mean = rows.mean(axis=0)
    scale = np.maximum(rows.std(axis=0), 1e-3)
    x = np.concatenate([(rows - mean) / scale, np.ones((len(rows), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - penalty * w
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def co_train(content: np.ndarray, metadata: np.ndarray, labels: np.ndarray, rounds: int = 4, share: float = 0.1) -> tuple[Linear, Linear]:
    """Fit both views; ``labels`` is 1, 0 or -1. In each round a view labels up to ``share`` of the unlabelled rows for the other."""
    known = labels >= 0
    views = [content, metadata]
    own = [labels.copy(), labels.copy()]
    weight = [known.astype(float), known.astype(float)]
    fitted: list[Linear] = []
    for turn in range(rounds + 1):
        fitted = [logistic(v[w > 0], np.maximum(y, 0)[w > 0].astype(float), w[w > 0], ridge=5.0) for v, y, w in zip(views, own, weight, strict=True)]
        if turn == rounds:
            break
        for i in (0, 1):
            other = 1 - i
            odds = fitted[i].score(views[i])
            open_rows = np.flatnonzero(~known & (weight[other] == 0))
            order = open_rows[np.argsort(-np.abs(odds[open_rows]), kind="stable")]
            # Confident: nine to one at least. Metadata alone rarely is.
            take = order[: int(share * (~known).sum())]
            take = take[np.abs(odds[take]) > np.log(9)]
            own[other][take] = odds[take] > 0
            weight[other][take] = 0.3
    return fitted[0], fitted[1]


def features(batches: Iterator[pa.RecordBatch], names: dict[str, str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, names["text"]):
            meta = metadata_features(*(part.column(names[c]).to_pylist() for c in ("source", "lang", "n_chars")))
            yield part, content_features(part.column(names["text"])), meta


NAMES = {"text": "text", "source": "source", "lang": "lang", "n_chars": "n_chars"}


def fit(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", per_class: int = 2_000, unlabelled: int = 2_000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class and ``unlabelled`` further rows, all drawn by the hash of the key."""
    found = sample_ids(labels, key, label, (0, 1), per_class)
    totals = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    chosen = {k for k, _ in found}
    more = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k", F.lit(1)), "k").limit(unlabelled).collect()
    found += [(r["k"], -1) for r in more if r["k"] not in chosen]
    sample = sample_frame(documents.select(F.col(key).alias("k"), *NAMES), found, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, content, meta in features(batches, NAMES):
            rows = np.concatenate([content, meta], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("k").cast(pa.string()), part.column("sample_label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["k", "label", "row"])

    rows = sorted(sample.mapInArrow(run, "k string, label int, row binary").collect(), key=lambda r: (r["k"], r["label"], r["row"])) if found else []
    y = np.array([r["label"] for r in rows], np.int64)
    share = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 1.0
    if not ((y == 0).sum() >= 4 and (y == 1).sum() >= 4):
        odds = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        flat = [Linear(np.zeros(n), np.ones(n), np.zeros(n), 0.0) for n in (N_TEXT, META_BUCKETS + 2, 2)]
        return Model(flat[0], flat[1], flat[2]._replace(bias=odds))
    x = np.array([np.frombuffer(r["row"], np.float32) for r in rows]).astype(np.float64)
    content, meta = x[:, :N_TEXT], x[:, N_TEXT:]
    # Log odds of labelled rows from views that were fitted without them: three folds.
    odds = np.zeros((len(y), 2))
    fold = np.arange(len(y)) % 3
    for f in range(3):
        hidden = np.where(fold == f, -2, y)
        some = hidden != -2
        views = co_train(content[some], meta[some], hidden[some])
        odds[fold == f] = np.stack([views[0].score(content[fold == f]), views[1].score(meta[fold == f])], axis=1)
    known = y >= 0
    # The sample is balanced by class; weights restore the classes' shares.
    weights = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1)) * known.sum()
    combined = logistic(np.clip(odds[known], -12, 12), y[known].astype(float), weights[known], ridge=0.5)
    return Model(*co_train(content, meta, y), combined)


def score(df: DataFrame, model: Model, *, limit: float = 0.5) -> DataFrame:
    """Add ``score`` (probability of good quality), the calibrated log odds of both views, and ``kept``: score at least ``limit``."""
    kept = [c for c in df.columns if c not in ("score", "content_odds", "metadata_odds", "kept")]
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "score double, content_odds double, metadata_odds double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content_model, meta_model, combined = shared.value
        for part, content, meta in features(batches, NAMES):
            odds = np.clip(np.stack([content_model.score(content), meta_model.score(meta)], axis=1), -12, 12)
            value = 1 / (1 + np.exp(-np.clip(combined.score(odds), -30, 30)))
            own = [pa.array(value), pa.array(odds[:, 0]), pa.array(odds[:, 1]), pc.greater_equal(pa.array(value), limit)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *own], [*kept, "score", "content_odds", "metadata_odds", "kept"])

    return df.select(*kept).mapInArrow(run, schema)
