"""Components equal those of all pairs compared one by one."""

import re

import numpy as np
import pytest
from edge_rows import documents, frame, prose, row

from lexmill.llm import minhash_dedup
from lexmill.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    label = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not s or not sets[j]:
                continue
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(a), find(b)
                label[max(a, b)] = min(a, b)
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize(("size", "seed"), [(4, 5), (5, 8)])
def test_components_equal_brute_force(spark, size, seed):
    rows = documents(seed)
    made = minhash_dedup.near_duplicates(frame(spark, rows), size=size)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in made.collect()), key=repr)
    assert found == brute(rows, size)


def test_large_buckets_and_chains(spark, monkeypatch):
    """A chain of texts that each differ a little from the one before; no bucket's pairs count as few."""
    import random

    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", 0)
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", 1)
    rng = random.Random(2)
    words = prose(rng, "en", 120).split(" ")
    rows = []
    for i in range(40):
        words = list(words)
        words[(i * 37) % len(words)] = f"new{i}"
        rows.append(row(200 - i, " ".join(words)))
    rng.shuffle(rows)
    made = minhash_dedup.near_duplicates(frame(spark, rows), size=4)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in made.collect()), key=repr) == brute(rows, 4)


def test_pairs_of_a_group_below_the_similarity_do_not_grow_with_its_square(spark, monkeypatch):
    """All texts share bands, but most have too many words of their own for a link; all links are found."""
    import random

    rng = random.Random(3)
    words = prose(rng, "en", 200).split(" ")
    rows = []
    for i in range(400):
        changed = list(words)
        for at in rng.sample(range(4, len(words) - 4), 1 if i % 20 == 0 else 7 + i % 3):
            changed[at] = f"new{i}at{at}"
        rows.append(row(i, " ".join(changed)))
        if i % 25 == 7:
            rows.append(row(1000 + i, " ".join([*changed[:-1], "end"])))
    given, real = [], minhash_dedup.likely
    monkeypatch.setattr(minhash_dedup, "likely", lambda pairs, *rest: given.append(pairs.distinct().count()) or real(pairs, *rest))
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", 2)
    made = minhash_dedup.near_duplicates(frame(spark, rows), size=4)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in made.collect()), key=repr) == brute(rows, 4)
    assert sum(given) < 20 * len(rows)


def test_keep_first(spark):
    rows = documents()
    df = frame(spark, rows)
    kept = minhash_dedup.keep_first(df, size=4)
    assert kept.columns == df.columns
    expected = [i for i, _, c in brute(rows, 4) if i is None or i == c]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = np.random.RandomState(1)
    links = [(int(a), int(a) + 1) for a in range(0, 300, 1) if a % 50] + [(1000, int(x)) for x in rng.randint(1001, 1400, 300)] + [(5000, 5000)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}
    for a in range(1, 301):
        label[a] = a if (a - 1) % 50 == 0 else label[a - 1]
    assert all(found[a] == label[a] for a in range(1, 301) if a in found)
    assert all(found[b] == 1000 for a, b in links if a == 1000)
