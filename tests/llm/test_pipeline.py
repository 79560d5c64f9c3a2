"""The stages against plain Python, each on what the one before kept."""

import re

import corpus_pipeline
import pytest
import sentencepiece
from edge_rows import documents, row
from test_decontamination import items_and_documents
from test_minhash_dedup import brute as near_groups
from test_substring_dedup import brute as repeats

from lexmill.llm import stages
from lexmill.llm.queries import SENTENCEPIECE_MODEL

COLUMNS = stages.COLUMNS


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A table folder with whole documents, benchmark items and labels."""
    path = tmp_path_factory.mktemp("tables")
    items, rows = items_and_documents()
    rows = [r for r in rows if r[0] is not None] + [row(700 + i, "*** " * (30 + i)) for i in range(12)]
    ids = sorted({r[0] for r in rows})
    data = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 700), 0) for i in ids if i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    good = stages.good_documents(spark, docs, folder)
    before, kept = [tuple(r) for r in docs.collect()], [tuple(r) for r in good.collect()]
    assert good.columns == COLUMNS and set(kept) <= set(before)
    assert {r[0] for r in before if r[0] >= 700} & {r[0] for r in kept} == set()
    assert {r[0] for r in before if 100 <= r[0] < 700} <= {r[0] for r in kept}

    rows = [row(*r[:4]) for r in kept]
    near = stages.first_of_near_copies(spark, good, folder)
    first = {i for i, _, c in near_groups(rows, 5) if i == c}
    assert near.columns == COLUMNS and {r["doc_id"] for r in near.collect()} == first

    rows = [r for r in rows if r[0] in first]
    whole = spark.createDataFrame([r[:5] for r in rows], docs.schema)
    cut = {r["doc_id"]: r for r in stages.without_repeats(spark, whole, folder).collect()}
    left = {i: (n, gone) for i, n, gone, _ in repeats(rows, 50)}
    assert set(cut) == {i for i, (n, gone) in left.items() if not (n and gone == n)}
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) == left[i][0] - left[i][1] for i, r in cut.items())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.values())

    clean = stages.without_benchmark(spark, whole, folder)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows if not 500 <= r[0] < 512}


def test_run(spark, folder):
    made = corpus_pipeline.run(spark, folder).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    assert made and all(r["exact"] for r in made if r["ids"] is not None)
    assert not {r["doc_id"] for r in made} & set(range(500, 512)) and not any(r["doc_id"] >= 700 for r in made)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    untouched = [r for r in made if r["ids"] is not None and library.decode(r["ids"]) == texts[r["doc_id"]]]
    assert len(untouched) > len(made) / 2
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in untouched)


def test_documents_fixture_has_copies():
    assert len({r[1] for r in documents()}) < len(documents())
