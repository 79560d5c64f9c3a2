"""Matches equal a plain BM25 and overlap count over all passages and items."""

import math
import random
import re

from edge_rows import documents, frame, prose, row

from lexmill.llm import decontamination


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_scores(items, passage):
    """BM25 of every item for a passage's distinct words, as a share of the item's own score."""
    words = [tokens(t) for _, t in items]
    mean = sum(map(len, words)) / len(words)
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for w in words:
        def weight(x, w=w):
            tf = w.count(x)
            idf = math.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5))
            return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

        total = sum(weight(x) for x in set(w))
        out.append(sum(weight(x) for x in set(w) & set(passage)) / max(total, 1e-12) if w else 0.0)
    return out


def items_and_documents():
    rng = random.Random(4)
    items = [(i, prose(rng, ("en", "fr")[i % 2], rng.randint(12, 50)) + ". " + prose(rng, "en", 8).capitalize() + ".") for i in range(40)]
    items += [(100, "one two"), (101, ""), (102, None), (None, "no id"), (103, items[3][1])]
    rows = documents()
    for k in range(12):
        text = items[k][1]
        if k % 3 == 1:
            text = text.upper().replace(" ", "\n ")
        if k % 3 == 2:
            words = text.split(" ")
            words[2] = "other"
            text = " ".join(words)
        rows.append(row(500 + k, f"{prose(rng, 'en', rng.randint(0, 150))} {text} {prose(rng, 'en', rng.randint(0, 90))}"))
    rows.append(row(600, items[20][1][:40]))
    return items, rows


def test_search_equals_brute_force():
    import numpy as np
    import pyarrow as pa

    items, rows = items_and_documents()
    known = [(i, t) for i, t in items if i is not None and t is not None]
    index = decontamination.build([i for i, _ in known], [t for _, t in known], 0.5)
    may = np.ones(1 << 16, bool)
    for r in rows:
        words, firsts, _, _ = decontamination.tokens(pa.array([r[1]]))
        plain = tokens((r[1] or "").lower())
        found = {(s, i): v for _, s, i, v in decontamination.search(index, words, firsts, 0.5, may)}
        step = index.passage // 2
        starts = range(0, max((len(plain) - 1) // step, 1) * step, step) if plain and len(plain) < 5000 else []
        expected = {}
        for start in starts:
            for i, v in enumerate(brute_scores(known, plain[start : start + index.passage])):
                if v >= 0.5 - 1e-9:
                    expected[start, i] = v
        if starts:
            assert set(found) == set(expected)
            assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items())


def test_planted_items_are_found_and_clean_documents_left(spark):
    items, rows = items_and_documents()
    items_frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id long")
    found = decontamination.matches(frame(spark, rows), items_frame).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    planted = {(500 + k, k) for k in range(12)} | {(503, 103)}
    assert pairs == planted
    assert all(r["question_overlap"] >= 0.5 and r["answer_overlap"] >= 0.5 for r in found)
    kept = decontamination.keep_clean(frame(spark, rows), items_frame)
    assert kept.count() == len(rows) - 12 and kept.columns == frame(spark, rows).columns


def test_several_shards(spark, monkeypatch):
    items, rows = items_and_documents()
    monkeypatch.setattr(decontamination, "SHARD", 15)
    items_frame = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(frame(spark, rows), items_frame).collect()}
    assert found == {(500 + k, k) for k in range(12)} | {(503, 103)}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matches(frame(spark, documents()), items).count() == 0
    assert decontamination.matches(frame(spark, []), items).count() == 0
