"""Array files read in splits give what the whole-file scan gives."""

import json
import os
import random

import pytest

from lexmill.sources import array_splits, articles

ODD = {
    "empty": "[]", "blank": " [ \n ] \n", "zero": "", "spaces": "  \n ", "object": '{"v": "}", "articles": [{"text": "x"}, [1, "]"]]}', "string": '"a } b"', "number": "12",
    "empty_object": "{ }", "cut": '[{"title": "c", "text": "x"}', "cut_string": '[{"text": "x}', "trailing": '[{"text": "x"},]', "double": '[{"text": "x"},,{"text": "y"}]',
    "leading": '[,{"text": "x"}]', "after": '[{"text": "x"}] {"text": "y"}', "two": '[{"text": "x"}][{"text": "y"}]', "closed_twice": '[{"text": "x"}]]', "mixed": '[{"text": "x"]}',
    "wrong": '[{"text": "x"}}', "scalars": '["abc", 1, {"text": "x"}]', "strings": '["a,b", ["}", "]"], {"text": "x"}]', "no_text": '[{"title": "l"}, {"text": "kept"}]',
    "null_text": '[{"text": null}, {"text": "kept"}]', "repeated": '[{"text": "one", "text": "last"}]', "escapes": '[{"text": "\\"}\\\\", "title": "\\\\\\"["}, {"text": "{[\\u007d"}]',
    "before": 'x [{"text": "x"}]', "only_open": "[", "only_close": "]", "braces": '[{"a": {"b": [{}, {"c": "}{"}]}, "text": "deep"}, {"text": "}"}]', "quote": '["', "brace_end": '[{"text": "x"}, {"text": "y"}',
    "object_cut": '{"articles": [1, 2', "nothing": '{"a": 1}', "bytes": None,
}


def write_files(folder):
    os.makedirs(f"{folder}/AA")
    rng = random.Random(3)
    for name, text in ODD.items():
        with open(f"{folder}/AA/{name}.json", "wb") as out:
            out.write(b'[{"text": "\xff\xfe"}]' if text is None else text.encode())
    for number, indent in enumerate((None, 2, 0, "\t")):
        records = [
            {"title": f"t{i}", "text": "".join(rng.choice('ab"\\{}[],: \né漢') for _ in range(rng.randint(0, 120))), "more": [[{"x": "}"}], {}]}
            for i in range(10)
        ]
        records.insert(3, {"title": "large", "text": "}" * 300 + '"' * 20 + "é" * 500})
        with open(f"{folder}/AA/made{number}.json", "w", encoding="utf-8") as out:
            json.dump(records, out, ensure_ascii=number % 2 == 0, indent=indent)
    return str(folder)


@pytest.fixture(params=[400, 1 << 20])
def files(request, spark, tmp_path):
    """The same files in splits of few bytes, where an element spans many of them, and in one split."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield write_files(tmp_path / "in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("mode", ["lenient", "strict"])
def test_rows_and_ledger_of_the_whole_file_scan(spark, files, mode):
    split, whole = array_splits.scan_split_arrays(spark, files, mode), articles.scan_arrays(spark, files, mode)
    assert bag(articles.load_ledger(split)) == bag(articles.load_ledger(whole))
    assert bag(articles.accepted(split)) == bag(articles.read_article_arrays(spark, files, mode))
    assert bag(array_splits.read_split_arrays(spark, files, mode)) == bag(articles.read_article_arrays(spark, files, mode))


def test_audit_of_the_whole_file_scan(spark, files):
    assert bag(array_splits.count_split_files(spark, files)) == bag(articles.count_array_files(spark, files))


def test_one_line_is_read_by_many_tasks(spark, files):
    pieces = array_splits._pieces(spark, files, "made0.json")
    splits = {(row["file_path"], row["start"]) for row in array_splits._split_states(pieces).collect()}
    size = os.path.getsize(f"{files}/AA/made0.json")
    limit = int(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    assert len(splits) > size / limit / 8 and (limit > size or len(splits) > 5)
