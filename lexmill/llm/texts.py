"""Whole texts as numpy arrays inside Arrow batches: words, their hashes, and runs of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Batches are cut
into slices of a few megabytes of text, so that the arrays stay small; a longer
document forms a slice of its own and its words are hashed span by span.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import new_shared_path

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTERS = np.zeros(256, bool)  # bytes of a letter run: ASCII letters and everything beyond ASCII
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True

#: Odd multipliers modulo 2**64 and their inverses.
BYTE_BASE, RUN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: what follows does not depend on lost executors."""
    path = new_shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named columns, under names of ours: extra columns of the input cannot clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have at most ``limit`` bytes, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each text in them; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are ``inside``, and for each text the index of its first run (and the total)."""
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    start[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; tables of moderate size are kept."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base]
    n = 1 << max(16, (n - 1).bit_length())
    inverse = pow(base, -1, 1 << 64)
    made = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * SLICE_BYTES:
        _powers[base] = tuple(made)
    return tuple(made)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; words are taken in spans of a few megabytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        n = int(ends[to - 1]) - base
        up, down = powers(BYTE_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mixed((sums[e] - sums[s]) * down[s])
        at = to
    return out


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each ``length`` consecutive words; entry i starts at word i. Runs may cross texts: see ``within``."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length <= 8:
        total = words[:n].copy()
        for j in range(1, length):
            total *= np.uint64(RUN_BASE)
            total += words[j : j + n]
        return mixed(total)
    up, down = powers(RUN_BASE, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:n])


def within(firsts: np.ndarray, length: int) -> np.ndarray:
    """Whether a run of ``length`` words from each word on stays in its text; ``firsts`` as from ``word_bounds``."""
    last = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(len(last)) + length <= last


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def exact_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each distinct run of bytes ``starts[i]:ends[i]``, and the runs by number.

    The bytes themselves are compared, no hash stands for them. The runs must be
    in order and disjoint; the gaps between them are the odd elements of one
    Arrow array over the same bytes, so nothing is copied.
    """
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    offsets = np.empty(2 * len(starts), np.int64)
    offsets[::2], offsets[1::2] = starts, ends
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    runs = parts.take(pa.array(np.arange(0, len(offsets) - 1, 2))).dictionary_encode()
    return runs.indices.to_numpy().astype(np.int64), runs.dictionary
