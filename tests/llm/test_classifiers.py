"""Language, quality and toxicity: held-out accuracy, exact neighbours, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import documents, edge_rows, frame, prose, row
from pyspark.sql import functions as F

from lexmill.llm import language_id, quality, toxicity
from lexmill.llm.sampling import held_out


def labelled(n=240, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(1000, 1000 + n):
        lang = ("en", "fr", "de")[i % 3]
        words = prose(rng, lang, rng.randint(20, 120)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        good = i % 5 != 0
        text = " ".join(words) if good else " ".join(w + "***" for w in words)
        rows.append(row(i, text, lang, "src0" if not good and i % 10 == 0 else f"src{i % 7 + 1}"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def labels_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_is_by_checksum(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_language(spark):
    rows, _ = labelled()
    rows += edge_rows()
    df = frame(spark, rows)
    model = language_id.fit(df.where(~held_out("doc_id")), key="doc_id", text="text", lang="lang")
    made = language_id.predict(df.select("doc_id", "lang", "text", "h"), model).collect()
    assert len(made) == len(rows)
    clear = [r for r in made if r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in clear]) > 0.98
    by_id = {r["doc_id"]: r for r in made}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4
    assert all(r["rejected"] and r["score"] == 0 for r in made if r["lang_pred"] == "und")
    assert all(0 <= r["score"] <= 1 for r in made)
    assert by_id[8]["lang_pred"] in ("en", "fr", "de")


def test_no_language_is_left_out(spark):
    """70 languages, of words of their own, and document frequencies of all texts, not only of the sampled ones."""
    rng = random.Random(3)
    rows = []
    for j in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [row(2000 + 10 * j + i, " ".join(rng.choice(words) for _ in range(30)), f"l{j:02}") for i in range(4 + j % 3)]
    df = frame(spark, rows)
    model = language_id.fit(df, key="doc_id", text="text", lang="lang", per_language=3)
    assert set(model.languages) == {r[2] for r in rows}
    made = language_id.predict(df.select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in made]) > 0.98
    seen, _ = language_id.vectors(pa.array([r[1] for r in rows]))
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + (seen > 0).sum(axis=0))) + 1)


def test_language_without_labels(spark):
    df = frame(spark, documents()).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit(df, key="doc_id", text="text", lang="lang")
    assert {r["lang_pred"] for r in language_id.predict(df.select("doc_id", "text"), model).collect()} == {"und"}
    empty = frame(spark, [])
    assert language_id.predict(empty.select("doc_id", "text"), language_id.fit(empty, key="doc_id", text="text", lang="lang")).count() == 0


def test_quality(spark):
    rows, labels = labelled()
    train = [x for x in labels if x[0] % 2]
    df = frame(spark, rows + edge_rows())
    model = quality.fit(df, labels_frame(spark, train))
    made = {r["doc_id"]: r for r in quality.score(df.drop("id"), model).collect()}
    test = [x for x in labels if not x[0] % 2]
    assert np.mean([made[i]["kept"] == bool(q) for i, q, _ in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in made.values()) and 1 in made and None in made


@pytest.mark.parametrize("labels", [[], [(1000, 1, 0)], [(1001, None, None)]])
def test_quality_without_both_classes_keeps_all(spark, labels):
    df = frame(spark, documents())
    made = quality.score(df, quality.fit(df, labels_frame(spark, labels))).collect()
    assert all(r["kept"] for r in made)
    assert quality.score(frame(spark, []), quality.fit(frame(spark, []), labels_frame(spark, labels))).count() == 0


def test_views_learn_from_each_other():
    """With few labels, the metadata view profits from what the content view labels."""
    rng = np.random.RandomState(0)
    y = rng.randint(0, 2, 400)
    content = np.stack([y + rng.normal(0, 0.15, 400), rng.normal(size=400)], axis=1)
    meta = np.stack([y + rng.normal(0, 0.5, 400), rng.normal(size=400)], axis=1)
    known = np.where(np.arange(400) < 24, y, -1)
    _, alone = quality.co_train(content, meta, known, rounds=0)
    _, taught = quality.co_train(content, meta, known, rounds=6)
    accuracy = [np.mean((m.score(meta) > 0) == (y == 1)) for m in (alone, taught)]
    assert accuracy[1] >= accuracy[0] - 0.01 and accuracy[1] > 0.8


def test_toxicity(spark):
    rows, labels = labelled()
    df = frame(spark, rows + edge_rows())
    learn = labels_frame(spark, labels).where(~held_out("doc_id"))
    index = toxicity.fit(df, learn.select("doc_id", "toxic"))
    made = {r["doc_id"]: r for r in toxicity.score(df.select("doc_id", "text", "h"), index).collect()}
    assert all(made[i]["predicted"] == t for i, _, t in labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in made.values())
    assert made[1]["evidence"] == [] and made[1]["predicted"] == 0
    hit = next(made[i] for i, _, t in labels if t)
    assert hit["evidence"] and hit["evidence_cosine"] == sorted(hit["evidence_cosine"], reverse=True)


@pytest.mark.parametrize("labels", [[], [(1000, 1, 0)], [(4, 1, 1), (4, 1, 0), (77777, 1, 1)]])
def test_toxicity_with_few_labels(spark, labels):
    df = frame(spark, documents())
    learn = labels_frame(spark, labels).select("doc_id", "toxic")
    made = toxicity.score(df.select("doc_id", "text"), toxicity.fit(df.select("doc_id", "text"), learn)).collect()
    assert len(made) == df.count() and all(0 <= r["score"] <= 1 for r in made)
    empty = frame(spark, []).select("doc_id", "text")
    assert toxicity.score(empty, toxicity.fit(empty, learn)).count() == 0


def test_neighbours_are_exact():
    """Blocks that are not visited hold none of the nearest entries."""
    rng = np.random.RandomState(1)
    terms = np.arange(30, dtype=np.uint64)
    vectors = []
    for i in range(900):
        t = np.sort(rng.choice(30, rng.randint(1, 6), replace=False))
        vectors.append((i, int(rng.rand() < 0.4), tuple(t.tolist()), tuple(rng.randint(1, 4, len(t)).tolist())))
    idf = rng.uniform(1, 5, 30)
    index = toxicity.build(vectors, terms, idf, 40, 60, near=10)
    entries = sorted({v[2:] for v in vectors})
    dense = np.zeros((len(entries), 30))
    for i, (t, n) in enumerate(entries):
        dense[i, list(t)] = toxicity.weighted(np.array(t), np.array(n), idf)
    for _ in range(100):
        t = np.sort(rng.choice(30, rng.randint(1, 6), replace=False))
        w = toxicity.weighted(t, rng.randint(1, 4, len(t)), idf)
        query = np.zeros(30)
        query[t] = w
        expected = np.sort(dense @ query)[::-1][:10]
        found = toxicity.nearest(index, t, w, 10)
        assert np.allclose([c for c, _ in found], expected[expected > 0][: len(found)]) and len(found) == min(10, (dense @ query > 0).sum())


def test_neighbours_are_those_of_whole_texts(spark):
    """Evidence and cosines are those of all terms, also for texts that hold none of the terms that tell the label."""
    rows, labels = labelled()
    learn = labels_frame(spark, labels).where(~held_out("doc_id"))
    df = frame(spark, rows).select("doc_id", "text")
    made = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, learn.select("doc_id", "toxic"))).collect()}
    sample = {r["doc_id"] for r in learn.collect()}
    hashes, of = toxicity.text_terms(pa.array([r[1] for r in rows]))
    vectors = [{} for _ in rows]
    for h, i in zip(hashes.tolist(), of.tolist(), strict=True):
        vectors[i][h] = vectors[i].get(h, 0) + 1
    seen = {}
    for v in vectors:
        for h in v:
            seen[h] = seen.get(h, 0) + 1
    inside = {h for v, r in zip(vectors, rows, strict=True) if r[0] in sample for h in v}
    # Terms of no example are counted together with those of the same bucket.
    bucket = {}
    for h in seen.keys() - inside:
        bucket[h % toxicity.BUCKETS] = bucket.get(h % toxicity.BUCKETS, 0) + seen[h]
    idf = {h: np.log((1 + len(rows)) / (1 + (n if h in inside else bucket[h % toxicity.BUCKETS]))) + 1 for h, n in seen.items()}
    unit = []
    for v in vectors:
        w = {h: (1 + np.log(n)) * max(idf[h], 1) for h, n in v.items()}
        length = np.sqrt(sum(x * x for x in w.values()))
        unit.append({h: x / length for h, x in w.items()})
    for i, r in enumerate(rows):
        cosines = sorted((sum(x * unit[j].get(h, 0) for h, x in unit[i].items()) for j, o in enumerate(rows) if o[0] in sample), reverse=True)
        assert np.allclose(made[r[0]]["evidence_cosine"], cosines[:3]) and len(made[r[0]]["evidence"]) == 3


def test_isotonic_is_monotone():
    rng = np.random.RandomState(2)
    raw = rng.rand(200)
    x, y = toxicity.isotonic(raw, (rng.rand(200) < raw).astype(float), np.ones(200))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_letters_decide_what_has_a_language():
    rows, has = language_id.vectors(pa.array(["→ ≠ 12", "ß", None, "x"]))
    assert has.tolist() == [False, True, False, True] and rows.shape == (4, language_id.BUCKETS)
