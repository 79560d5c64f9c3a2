"""Removed words and digests equal a plain count of all windows."""

import hashlib
import re

import pytest
from edge_rows import documents, frame

from lexmill.llm import substring_dedup


def brute(rows, window):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            if r[0] is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[k : k + window])] < r[0]:
                gone[k : k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("window", "seed"), [(50, 5), (20, 6)])
def test_digest_equals_brute_force(spark, window, seed):
    rows = documents(seed)
    made = substring_dedup.digest(frame(spark, rows), window=window)
    assert order(map(tuple, made.collect())) == order(brute(rows, window))


def test_rows_left(spark):
    rows = documents()
    df = frame(spark, rows)
    left = substring_dedup.remove_repeats(df)
    assert left.columns == df.columns
    expected = sorted((i, hashlib.sha256(b"").hexdigest() if not n else h) for i, n, gone, h in brute(rows, 50) if i is not None and not (gone and gone == n))
    made = sorted((r["doc_id"], hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")).encode()).hexdigest()) for r in left.collect() if r["doc_id"] is not None)
    assert made == expected


def test_empty_table(spark):
    assert substring_dedup.digest(frame(spark, [])).count() == 0
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
