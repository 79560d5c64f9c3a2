"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased letter runs of a text and their first 4 and 5 bytes,
which stand for inflected forms. All terms of a bounded sample of labelled texts
are indexed; their document frequencies are counted over all documents. Every
example is scored for every text, so the neighbours are exact: terms that many
examples hold are a matrix, the others have postings. Terms that no example
holds lengthen a text's vector, by document frequencies counted in buckets.
Examples with equal vectors are one entry with counts.

The votes of the nearest entries are weighted by distance and calibrated on the
sample, each example without itself, under the labels' own class shares. Beside
them vote the nearest entries by those terms alone that strongly depend on the
label by chi-square; a logistic model of both votes gives the score. Evidence
are the neighbours by whole vectors. Texts without known terms, null and empty
ones get the share of toxic examples among texts like them. Ties between entries
go to the smaller example id.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.language_id import lowered
from lexmill.llm.sampling import sample_frame, sample_ids
from lexmill.llm.texts import LETTERS, slices, text_bytes, word_bounds, word_hashes

PREFIXES = (4, 5)
#: Terms that more than one in ``DENSE`` entries holds are rows of a matrix, the others have postings.
DENSE = 16
#: Queries that are scored together.
QUERIES = 256
#: Buckets of the document frequencies of terms that no example holds; they only lengthen a text's vector.
BUCKETS = 1 << 20


class Index(NamedTuple):
    """Terms and their IDF; the row of each frequent term in ``matrix`` (or -1); postings of the others, bounded by ``begin``; the entries' votes; the calibration."""

    terms: np.ndarray
    idf: np.ndarray
    other_idf: np.ndarray
    row: np.ndarray
    matrix: np.ndarray
    begin: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    example: list
    steps: tuple[np.ndarray, np.ndarray]
    empty_score: float


class Model(NamedTuple):
    """The index of whole vectors, that of marked terms, the marked terms' positions there (or -1), and the weights of both votes."""

    whole: Index
    marked: Index
    mark: np.ndarray
    weights: np.ndarray


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and the text of each."""
    data, offsets = text_bytes(lowered(column))
    starts, ends, firsts = word_bounds(LETTERS[data], offsets)
    text = np.repeat(np.arange(len(column)), np.diff(firsts))
    hashes, of = [word_hashes(data, starts, ends)], [text]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes.append(word_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(n))
        of.append(text[longer])
    return np.concatenate(hashes), np.concatenate(of)


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of all texts; then text, term (its position among them) and count, one row per text and term, by text."""
    hashes, text = text_terms(column)
    code = pa.array(hashes).dictionary_encode()
    kinds = code.dictionary.to_numpy(zero_copy_only=False)
    keys, n = np.unique(text.astype(np.int64) * max(len(kinds), 1) + code.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return kinds, keys // max(len(kinds), 1), keys % max(len(kinds), 1), n


def known(terms: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The position of each of ``kinds`` in the sorted ``terms``, or -1."""
    if not len(terms):
        return np.full(len(kinds), -1)
    at = np.minimum(np.searchsorted(terms, kinds), len(terms) - 1)
    return np.where(terms[at] == kinds, at, -1)


def buckets(kinds: np.ndarray) -> np.ndarray:
    return (kinds % np.uint64(BUCKETS)).astype(np.int64)


def weighted(term: np.ndarray, n: np.ndarray, idf: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """TF-IDF weights over the length of the whole vector; ``outside`` is the squared length of terms not listed."""
    w = (1 + np.log(n)) * idf[term]
    return w / np.sqrt((w * w).sum() + outside)


def build(vectors: list[tuple], terms: np.ndarray, idf: np.ndarray, toxic_all: int, clean_all: int, near: int, other_idf: np.ndarray | None = None) -> Index:
    """The index of examples (id, label, terms, counts)."""
    return built(vectors, terms, idf, toxic_all, clean_all, near, other_idf)[0]


def built(vectors: list[tuple], terms: np.ndarray, idf: np.ndarray, toxic_all: int, clean_all: int, near: int, other_idf: np.ndarray | None = None) -> tuple[Index, np.ndarray]:
    """The index, and the calibrated votes for each of ``vectors`` without itself."""
    entries: dict[tuple, list] = {}
    empty = [0, 0]
    keys = [digest(v[2], v[3]) for v in vectors]
    for i in sorted(range(len(vectors)), key=lambda i: vectors[i][:2]):
        doc, label, term, n = vectors[i]
        if len(term):
            held = entries.setdefault(keys[i], [0, 0, doc, np.asarray(term, np.int32), np.asarray(n, np.int32)])
            held[1 - label] += 1
        else:
            empty[1 - label] += 1
    rows = [(term, n, a, b, doc) for a, b, doc, term, n in entries.values()]
    toxic, clean, example = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float), [r[4] for r in rows]
    term = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int32)])
    entry = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    weight = np.concatenate([weighted(r[0], r[1], idf) for r in rows] or [np.zeros(0)])
    often = np.bincount(term, minlength=len(terms)) * DENSE > len(rows)
    row = np.where(often, np.cumsum(often) - 1, -1)
    matrix = np.zeros((int(often.sum()), len(rows)))
    dense = often[term]
    matrix[row[term[dense]], entry[dense]] = weight[dense]
    term, entry, weight = term[~dense], entry[~dense], weight[~dense]
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
    entry, weight = entry[order], weight[order]
    n_toxic, n_clean = max(toxic.sum() + empty[0], 1), max(clean.sum() + empty[1], 1)
    w_toxic, w_clean = max(toxic_all, 0) / n_toxic, max(clean_all, 0) / n_clean
    toxic, clean = toxic * w_toxic, clean * w_clean
    share = toxic_all / max(toxic_all + clean_all, 1)
    empty_score = (empty[0] * w_toxic + share) / (empty[0] * w_toxic + empty[1] * w_clean + 1)
    other_idf = np.ones(BUCKETS) if other_idf is None else other_idf
    index = Index(terms, idf, other_idf, row, matrix, begin, entry, weight, toxic, clean, example, (np.zeros(0), np.zeros(0)), float(empty_score))
    raw, label, mass, of, names = [], [], [], [], list(entries)
    for at in range(0, len(rows), QUERIES):
        found = all_nearest(index, [(r[0], weighted(r[0], r[1], idf)) for r in rows[at : at + QUERIES]], near + 1)
        for i, best in enumerate(found, at):
            for own, value, unit in ((toxic[i], 1.0, w_toxic), (clean[i], 0.0, w_clean)):
                if own > 0:
                    raw.append(votes(index, best, without=(i, unit if value else 0.0, 0.0 if value else unit)))
                    label.append(value)
                    of.append((names[i], int(value)))
                    mass.append(own)
    index = index._replace(steps=isotonic(np.array(raw), np.array(label), np.array(mass)))
    alone = dict(zip(of, raw, strict=True))
    return index, np.array([calibrated(index, alone.get((key, v[1]))) for key, v in zip(keys, vectors, strict=True)])


def digest(term: np.ndarray, n: np.ndarray) -> bytes:
    """16 bytes that equal vectors share."""
    return hashlib.blake2b(np.asarray(term, np.int32).tobytes() + np.asarray(n, np.int32).tobytes(), digest_size=16).digest()


def calibrated(index: Index, raw: float | None) -> float:
    return index.empty_score if raw is None or not len(index.steps[0]) else float(np.clip(np.interp(raw, *index.steps), 0, 1))


def features(whole: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The log odds of both votes, and a constant."""
    p = np.clip(np.stack([whole, marked], axis=-1), 0.01, 0.99)
    return np.concatenate([np.log(p / (1 - p)), np.ones((*p.shape[:-1], 1))], axis=-1)


def logistic(x: np.ndarray, label: np.ndarray, mass: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model with a slight pull to the sum of both log odds' halves."""
    start = np.array([0.5, 0.5, 0.0])
    w = start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - label)) + (w - start)
        w = w - np.linalg.solve((x * (mass * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(3), slope)
    return w


def all_nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
    """For each query (terms and weights) cosine and entry of the ``k`` nearest entries, best first; every entry is scored."""
    left = np.zeros((len(queries), len(index.matrix)))
    for i, (term, weight) in enumerate(queries):
        row = index.row[term]
        left[i, row[row >= 0]] = weight[row >= 0]
    found = []
    for (term, weight), scores in zip(queries, left @ index.matrix, strict=True):
        begin, sizes = index.begin[term], index.begin[term + 1] - index.begin[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        scores = scores + np.bincount(index.entry[at], index.weight[at] * np.repeat(weight, sizes), minlength=len(scores))
        worst = max(np.partition(scores, -k)[-k] - 1e-12, 0) if len(scores) > k else 0
        best = [(float(scores[j]), j) for j in np.flatnonzero((scores >= worst) & (scores > 0)).tolist()]
        found.append(sorted(best, key=lambda f: (-round(f[0], 12), index.example[f[1]]))[:k])
    return found


def nearest(index: Index, term: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
    return all_nearest(index, [(term, weight)], k)[0]


def votes(index: Index, found: list[tuple[float, int]], without: tuple[int, float, float] = (-1, 0.0, 0.0)) -> float:
    """The share of toxic votes, each weighted by the square of its cosine; ``without`` takes an example out of an entry."""
    toxic = clean = 0.0
    for cosine, i in found:
        t, c = index.toxic[i], index.clean[i]
        if i == without[0]:
            t, c = max(t - without[1], 0.0), max(c - without[2], 0.0)
        # An entry's count tells less and less: many copies of one vector are not many witnesses.
        damp = np.log1p(t + c) / max(t + c, 1e-12)
        toxic += cosine**2 * t * damp
        clean += cosine**2 * c * damp
    base = index.toxic.sum() / max(index.toxic.sum() + index.clean.sum(), 1e-12)
    return float((toxic + 0.2 * base) / (toxic + clean + 0.2))


def isotonic(raw: np.ndarray, label: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone calibration with the least squared error, as points to interpolate between."""
    pools: list[list[float]] = []
    for i in np.lexsort((label, raw)).tolist():
        pools.append([raw[i] * mass[i], label[i] * mass[i], mass[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3_000, near: int = 15) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class; ``documents`` are all texts, ``labels`` only those to learn from."""
    found = sample_ids(labels, key, label, (0, 1), per_class)
    totals = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    sample = sample_frame(documents.select(F.col(key).alias("k"), F.col(text).alias("source")), found, "k")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source"):
                kinds, of, term, n = counted(part.column("source"))
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1)).tolist()
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                lists = [[x[a:b].tobytes() for a, b in spans] for x in (kinds[term], n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("sample_label"), *(pa.array(x, pa.binary()) for x in lists)], ["k", "label", "term", "n"])

    kind = dict(documents.dtypes)[key]
    rows = sample.mapInArrow(vectors, f"k {kind}, label int, term binary, n binary").collect() if found else []
    terms = np.zeros(0, np.uint64)
    for at in range(0, len(rows), QUERIES):
        terms = np.unique(np.concatenate([terms, *(np.frombuffer(r["term"], np.uint64) for r in rows[at : at + QUERIES])]))
    examples = []
    while rows:
        k, value, term, n = rows.pop()
        at = known(terms, np.frombuffer(term, np.uint64)).astype(np.int32)
        # In order of the terms, as the vectors of texts to be scored.
        order = np.argsort(at)
        examples.append((k, value, at[order], np.frombuffer(n, np.int32)[order]))
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, rows = np.zeros(len(terms) + BUCKETS + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch, "source"):
                kinds, _, term, _ = counted(part.column("source"))
                at = known(terms, kinds)
                np.add.at(total, np.where(at >= 0, at, len(terms) + buckets(kinds)), np.bincount(term, minlength=len(kinds)))
        total[-1] = rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    df = np.zeros(len(terms) + BUCKETS + 1)
    sums = documents.select(F.col(text).alias("source")).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # Two terms of one bucket can have more documents together than there are.
    idf, other = idf[: len(terms)], np.maximum(idf[len(terms) :], 1)
    whole, by_all = built(examples, terms, idf, totals.get(1, 0), totals.get(0, 0), near, other)
    toxic = np.array([e[1] == 1 for e in examples], bool)
    mark = marks(examples, toxic, len(terms))
    few = []
    for k, value, t, n in examples:
        own = mark[t] >= 0
        few.append((k, value, mark[t[own]], n[own]))
    marked, by_marks = built(few, terms[mark >= 0], idf[mark >= 0], totals.get(1, 0), totals.get(0, 0), near)
    mass = np.where(toxic, totals.get(1, 0) / max(toxic.sum(), 1), totals.get(0, 0) / max((~toxic).sum(), 1))
    # The model sees as much mass as there are examples, so that the pull does not depend on the labels left out.
    mass = mass * (len(mass) / max(mass.sum(), 1e-12))
    return Model(whole, marked, mark, logistic(features(by_all, by_marks), toxic.astype(float), mass))


def marks(examples: list[tuple], toxic: np.ndarray, size: int) -> np.ndarray:
    """New positions of the terms whose dependence on the label is beyond chance (chi-square over 20) and strong (8 times as frequent in one class); -1 for others."""
    none = np.zeros(0, np.int32)
    a, b = (np.bincount(np.concatenate([none, *(e[2] for e, t in zip(examples, toxic, strict=True) if t == c)]), minlength=size) for c in (True, False))
    n_a, n_b = toxic.sum(), (~toxic).sum()
    mean = (a + b) / max(n_a + n_b, 1)
    gap = (a / max(n_a, 1) - b / max(n_b, 1)) ** 2 / np.maximum(mean * (1 - mean), 1e-9)
    lift = ((a + 0.5) / (n_a + 1)) / ((b + 0.5) / (n_b + 1))
    strong = (a + b >= 3) & (gap * (n_a * n_b / max(n_a + n_b, 1)) > 20) & (np.maximum(lift, 1 / lift) >= 8)
    return np.where(strong, np.cumsum(strong) - 1, -1)


def score(df: DataFrame, index: Model, text: str = "text", *, near: int = 15, limit: float = 0.3, evidence: int = 3) -> DataFrame:
    """Replace the text by ``score``, ``predicted`` and the nearest examples' ids and cosines; narrow."""
    kept = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(index)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "score double, predicted int, evidence array<long>, evidence_cosine array<double>"])

    def answered(model: Model, column: pa.Array) -> list[tuple]:
        index = model.whole
        kinds, of, kind, n = counted(column)
        at, other = known(index.terms, kinds), index.other_idf[buckets(kinds)]
        own = at[kind] >= 0
        length = np.bincount(of[~own], ((1 + np.log(n[~own])) * other[kind[~own]]) ** 2, minlength=len(column))
        order = np.lexsort((at[kind[own]], of[own]))
        of, term, n = of[own][order], at[kind[own]][order], n[own][order]
        bounds = np.searchsorted(of, np.arange(len(column) + 1))
        out = [(index.empty_score, [], [])] * len(column)
        some = np.flatnonzero(np.diff(bounds))
        for first in range(0, len(some), QUERIES):
            texts = some[first : first + QUERIES].tolist()
            pairs = [(term[a:b], n[a:b]) for i in texts for a, b in (bounds[i : i + 2],)]
            found = all_nearest(index, [(t, weighted(t, c, index.idf, length[i])) for i, (t, c) in zip(texts, pairs, strict=True)], near)
            few = [(model.mark[t[m]], c[m]) for t, c in pairs for m in (model.mark[t] >= 0,)]
            held = [j for j, (t, _) in enumerate(few) if len(t)]
            by_marks = np.full(len(texts), model.marked.empty_score)
            for j, best in zip(held, all_nearest(model.marked, [(few[j][0], weighted(*few[j], model.marked.idf)) for j in held], near), strict=True):
                by_marks[j] = calibrated(model.marked, votes(model.marked, best))
            by_all = np.array([calibrated(index, votes(index, best)) for best in found])
            values = 1 / (1 + np.exp(-np.clip(features(by_all, by_marks) @ model.weights, -30, 30)))
            for i, value, best in zip(texts, values.tolist(), found, strict=True):
                out[i] = (value, [index.example[j] for _, j in best[:evidence]], [c for c, _ in best[:evidence]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, text):
                out = answered(index, part.column(text))
                scores = [o[0] for o in out]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                    [*kept, "score", "predicted", "evidence", "evidence_cosine"],
                )

    return df.mapInArrow(run, schema)
