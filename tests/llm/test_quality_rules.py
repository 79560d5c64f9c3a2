import compare
import edge_rows
import pyarrow as pa
import pytest
from sql_twin import sql_rows
from pyspark.sql import functions as F

from lexmill.llm import quality_rules
from lexmill.llm.oracles import ORACLES

SCHEMA = {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()}


def expected(rows):
    return sql_rows(ORACLES["op13_quality_rules"], "documents", [(row[0], row[1], row[3]) for row in rows], SCHEMA)


def found(spark, rows):
    judged = quality_rules.judge(edge_rows.frame(spark, rows))
    rates = [F.round(f"rate_{rule}", 9).alias(f"rate_{rule}") for rule in quality_rules.RULES]
    return compare.spark_bag(judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "host_rejected", "kept", *rates))


def plain_measures(text):
    """The measures of one text, word by word."""
    blanks = {chr(c) for c in (0x20, *range(0x09, 0x0E))}
    text = text or ""
    words = "".join(" " if c in blanks else c for c in text).split(" ")
    words = [word for word in words if word]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, window in enumerate(windows) if windows.count(window) > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if set(line) - blanks]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_python(spark):
    texts = [
        None, "", " \n\t\n", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x y\nx y\n\n\n x y\nx y", "é# 漢<字>\x0b&\r\n&\n&",
        "a b c d\ne f a b c d e", "p q r s t u p q r s t v p q r s t", "\x00 \x00\n\x00 \x00", "\x85 \xa0 word", "&|" * 50,
    ]
    rows = [edge_rows.row(i, text) for i, text in enumerate(texts)]
    measured = quality_rules.measures(edge_rows.frame(spark, rows).coalesce(1)).orderBy("doc_id").collect()
    assert [tuple(row[name] for name in quality_rules.MEASURES) for row in measured] == [plain_measures(text) for text in texts]


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_sql(spark, seed):
    rows = edge_rows.documents(seed, n=80)
    assert found(spark, rows) == expected(rows)


def bad_host_rows():
    good, bad = "one two three four five six seven eight nine ten eleven", "junk"
    rows = [edge_rows.row(i, good, "en", f"host{i % 7}") for i in range(140)]
    rows += [edge_rows.row(1000 + i, bad, "en", "spam") for i in range(60)] + [edge_rows.row(2000 + i, good, "en", "spam") for i in range(20)]
    return rows + [edge_rows.row(3000, bad, "en", "tiny"), edge_rows.row(3001, good, "en", None), edge_rows.row(3002, bad, "en", None)]


def test_a_failing_host_takes_its_documents_along(spark):
    rows = bad_host_rows()
    judged = {row["doc_id"]: row for row in quality_rules.judge(edge_rows.frame(spark, rows)).collect()}
    assert found(spark, rows) == expected(rows)
    assert not judged[2000]["kept"] and not judged[2000]["base_failed"] and judged[2000]["host_rejected"]
    assert judged[0]["kept"] and judged[3001]["kept"] and not judged[3002]["kept"]


def test_small_hosts_are_shrunk_more(spark):
    """One failure of one document says less than sixty of eighty."""
    rates = {row["host"]: row["rate_base"] for row in quality_rules.judge(edge_rows.frame(spark, bad_host_rows())).collect()}
    assert rates["host0"] < rates["tiny"] < 1 and abs(rates["spam"] - 0.75) < 0.05


def test_equal_hosts_get_the_common_rate(spark):
    rows = [edge_rows.row(i, "junk" if i % 10 == 0 else "a b c d e f g h i j k", "en", f"h{i // 10}") for i in range(50)]
    assert {row["rate_base"] for row in quality_rules.judge(edge_rows.frame(spark, rows)).collect()} == {0.1}


def test_a_single_host_and_no_rows(spark):
    one = [edge_rows.row(1, "junk", None, "h"), edge_rows.row(2, "a b c d e f g h i j k", None, "h")]
    assert found(spark, one) == expected(one)
    assert quality_rules.judge(edge_rows.frame(spark, one).limit(0)).count() == 0
