"""Joining symbol pairs in many words at once, on arrays inside a task.

Symbols are token ids. Words lie end to end in one array, with their lengths in
another, so that a round of joins is a few array operations for all words.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these helpers with the closure, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIRST_SYMBOL = 0x100
_SURROGATES, _SURROGATE_COUNT = 0xD800, 0x800
_NONE = np.iinfo(np.int32).max


def symbol(token_id: int) -> str:
    """The one character that stands for a token id in a training word."""
    point = token_id + _FIRST_SYMBOL
    return chr(point if point < _SURROGATES else point + _SURROGATE_COUNT)


def symbol_id(char: str) -> int:
    point = ord(char)
    return point - _FIRST_SYMBOL - (_SURROGATE_COUNT if point >= _SURROGATES else 0)


def row_slices(batch: pa.Array, words: int) -> Iterator[pa.Array]:
    """The rows of a batch of word lists in slices of at most so many words; a longer row is a slice of its own."""
    total = np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, before + words, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def symbols_of(words: pa.Array) -> tuple:
    """Training words as one id array and word lengths; all words are decoded at once."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    text = bytes(data[offsets[0] : offsets[-1]]).decode() if data is not None and len(words) else ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
    ids = points - _FIRST_SYMBOL - np.where(points >= _SURROGATES, _SURROGATE_COUNT, 0).astype(np.int32)
    return ids, pc.utf8_length(words).to_numpy(zero_copy_only=False)


def words_of_symbols(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Inverse of ``symbols_of``."""
    points = ids + _FIRST_SYMBOL
    points += np.where(points >= _SURROGATES, _SURROGATE_COUNT, 0).astype(points.dtype)
    data = points.astype(np.uint32).tobytes().decode("utf-32-le").encode()
    # Where each symbol starts in UTF-8: a symbol has two bytes, three or four.
    sizes = 2 + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    offsets = starts[np.concatenate(([0], np.cumsum(lengths)))].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def _keys(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a symbol has a right neighbour in its word, the key of both, and the word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(word[1:] == word[:-1])
    return at, ids[at].astype(np.int64) << 32 | ids[at + 1], word[at]


def pair_keys(pairs: list[str]) -> np.ndarray:
    """Sorted keys of pairs of training symbols."""
    return np.array(sorted(symbol_id(left) << 32 | symbol_id(right) for left, right in pairs), np.int64)


def _known(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def words_holding(words: pa.Array, known: np.ndarray) -> np.ndarray:
    """Whether each word holds one of the pairs."""
    _, keys, word = _keys(*symbols_of(words))
    found = np.zeros(len(words), bool)
    found[word[_known(keys, known)]] = True
    return found


def counted_pairs(words: pa.Array, weights: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct neighbouring pairs of the words and their summed weights."""
    _, keys, word = _keys(*symbols_of(words))
    distinct, back = np.unique(keys, return_inverse=True)
    # Exact sums of whole numbers: differences of one running total over the pairs in order.
    order = np.argsort(back, kind="stable")
    totals = np.concatenate(([0], np.cumsum(weights[word][order])))
    sums = np.diff(totals[np.searchsorted(back[order], np.arange(len(distinct) + 1))])
    both = np.column_stack((distinct >> 32, distinct & 0xFFFFFFFF)).astype(np.int32)
    return words_of_symbols(both.ravel(), np.full(len(distinct), 2)), sums


def cut_words(words: pa.Array, weights: np.ndarray, known: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of at least two symbols whose neighbours are known pairs, with the weights of their words."""
    ids, lengths = symbols_of(words)
    at, keys, _ = _keys(ids, lengths)
    joined = np.zeros(len(ids), bool)  # to the right neighbour
    joined[at[_known(keys, known)]] = True
    after = np.concatenate(([False], joined[:-1]))
    first = np.flatnonzero(joined & ~after)
    last = np.flatnonzero(after & ~joined)
    sizes = last - first + 1
    inside = joined | after
    word = np.repeat(np.arange(len(lengths)), lengths)
    return words_of_symbols(ids[inside], sizes), weights[word[first]]


def join_table(merges: list) -> tuple:
    """``(left, right, joint)`` ids in rank order as plain arrays.

    Returns sorted pair keys, their ranks, the joint of each rank, and which
    ranks are *late*: their joint existed before them. A late join may form a
    pair of lower rank, which then goes first.
    """
    ranks, joints, late, made = {}, [], [], set()
    for rank, (left, right, joint) in enumerate(merges):
        ranks[left << 32 | right] = rank
        joints.append(joint)
        late.append(joint in made)
        made.add(joint)
    keys = np.array(sorted(ranks), np.int64)
    return (
        keys,
        np.array([ranks[key] for key in keys.tolist()], np.int32),
        np.array(joints, np.int32),
        np.array(late, bool),
    )


def _ranks_of(left: np.ndarray, right: np.ndarray, table: tuple) -> np.ndarray:
    keys, ranks = table[:2]
    wanted = left.astype(np.int64) << 32 | right
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, ranks[at], _NONE)


def join_words(ids: np.ndarray, lengths: np.ndarray, table: tuple, ascending: bool = False) -> tuple:
    """Join pairs in every word, lowest rank and leftmost first, until none is left.

    Each round joins, in every word that still has a known pair, all pairs of the
    word's lowest rank. With ``ascending`` no pair is joined after one of higher
    rank. Returns ids and lengths like its arguments.
    """
    joints, late = table[2:]
    if len(joints) == 0 or len(ids) == 0:
        return ids, lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(ids), _NONE, np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = _ranks_of(ids[inside], ids[inside + 1], table)
    done_ids, done_words = [], []
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(first, len(ids)))
        best = np.repeat(np.minimum.reduceat(rank, first), sizes)
        finished = best == _NONE
        done_ids.append(ids[finished])
        done_words.append(word[finished])
        active = ~finished
        ids, word, rank, best = ids[active], word[active], rank[active], best[active]

        at = np.flatnonzero(rank == best)
        if len(at) == 0:
            break
        # In a run of one symbol every other pair is joined.
        begins = np.concatenate(([True], np.diff(at) != 1))
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(at - at[run]) % 2 == 0]
        # A late pair is joined once, then the word is looked at again.
        repeats = np.concatenate(([False], word[at[1:]] == word[at[:-1]]))
        at = at[~(repeats & late[rank[at]] & (not ascending))]

        applied = rank[at]
        ids[at] = joints[applied]
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        rank[at] = _NONE
        ids, word, rank = ids[kept], word[kept], rank[kept]
        at = at - np.arange(len(at))
        floor = applied if ascending else np.full(len(at), -1, np.int32)
        for left in (at, at - 1):
            valid = (left >= 0) & (left + 1 < len(ids))
            valid[valid] = word[left[valid]] == word[left[valid] + 1]
            near = left[valid]
            found = _ranks_of(ids[near], ids[near + 1], table)
            rank[near] = np.where(found > floor[valid], found, _NONE)

    words = np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(done_ids)[order], np.bincount(words, minlength=len(lengths))
