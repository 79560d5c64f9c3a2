import compare
import edge_rows
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sql_twin import sql_rows

from lexmill.llm import source_divergence
from lexmill.llm.oracles import ORACLES

SQL = ORACLES["op11_source_divergence"]
SCHEMA = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}


def expected(rows):
    return sql_rows(SQL, "documents", [row[:4] for row in rows], SCHEMA)


def found(spark, rows):
    return compare.spark_bag(source_divergence.divergence(edge_rows.frame(spark, rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_sums_over_all_terms(spark, seed):
    """Odd rows, repeated ids and clashing columns included."""
    rows = edge_rows.documents(seed, n=80)
    assert found(spark, rows) == expected(rows)


def test_documents_of_a_term_in_several_chunks(spark):
    """A term is kept by distinct documents: one document with three spellings of it is one, two with two each are two."""
    texts = ["solo, solo. (solo)", "pair pair, x", "pair. pair; x", "trio, trio", "trio. x", "Trio! y", "http://a http://b http://c", "http://d", "x http://e y"]
    rows = [edge_rows.row(i, text, "en", f"s{i % 2}") for i, text in enumerate(texts)]
    counts = source_divergence.term_counts(edge_rows.frame(spark, rows))
    assert {row["term"] for row in counts.collect()} == {"trio", "x", "http"}
    assert found(spark, rows) == expected(rows)


def test_tasks_do_not_share_document_numbers(spark):
    rows = [edge_rows.row(None, "same, words", "en", None) for _ in range(3)]
    frame = edge_rows.frame(spark, rows).repartition(3)
    assert compare.spark_bag(source_divergence.divergence(frame)) == expected(rows)
    assert {row["term"] for row in source_divergence.term_counts(frame).collect()} == {"same", "words"}


def test_ties_rank_by_utf8_and_term_ranks_end_at_the_limit(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(250)]
    rows = [edge_rows.row(i, " ".join(words), "xx", "a") for i in range(3)] + [edge_rows.row(9 + i, "other", "xx", "b") for i in range(3)]
    rows.append(edge_rows.row(20, None, "xx", "c"))
    result = source_divergence.divergence(edge_rows.frame(spark, rows))
    assert compare.spark_bag(result) == expected(rows)
    assert result.where("part = 'term'").agg(F.max("rank")).first()[0] == 200


def test_probability_is_exact_for_large_counts(spark):
    rows = [(10**12, 10**13, 5), (2**62, 2**62 + 7, 10**9), (0, 0, 1), (0, 0, 0)]
    frame = spark.createDataFrame(rows, "c long, t long, s long").select(source_divergence.probability("c", "t", "s"))
    wanted = [1 + 10**9 * (c + 1) // (t + s) if t + s else None for c, t, s in rows]
    assert [row[0] for row in frame.collect()] == wanted


def test_no_kept_terms_and_no_rows(spark):
    rows = [edge_rows.row(1, "once only", "en", "a"), edge_rows.row(2, None, "en", "b"), edge_rows.row(3, "", "fr", "a")]
    assert found(spark, rows) == expected(rows)
    assert source_divergence.divergence(edge_rows.frame(spark, rows).limit(0)).count() == 0
