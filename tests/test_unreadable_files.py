"""Files that cannot be read, or not to their end, become ledger rows; all others are loaded."""

import gzip
import json
import os
import random
import zlib

import pytest

from lexmill.plans import stages
from lexmill.sources import articles

LINE = json.dumps({"title": "t", "text": "x" * 200}) + "\n"


def folder_of(tmp_path, files):
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(tmp_path)


def break_at(tmp_path, name, position):
    """A checksum file of the local file system that holds up to ``position`` and is wrong behind it."""
    path = tmp_path / name
    data, sums = path.read_bytes(), b"crc\x00" + (512).to_bytes(4, "big")
    for at in range(0, len(data), 512):
        right = zlib.crc32(data[at : at + 512])
        sums += (right if at + 512 <= position else right ^ 1).to_bytes(4, "big")
    (path.parent / f".{path.name}.crc").write_bytes(sums)


def ledger_of(scan):
    return {row["file"]: (row["status"], row["error"], row["n_articles"]) for row in articles.load_ledger(scan).collect()}


def test_lines_of_lost_and_broken_files(spark, tmp_path):
    path = folder_of(tmp_path, {"a/good": LINE * 3, "a/lost": LINE, "b/denied": LINE, "b/late": LINE * 2000, "b/zero": ""})
    break_at(tmp_path, "b/denied", 0)
    break_at(tmp_path, "b/late", 300_000)
    scan = articles.scan_jsonl(spark, path)
    (tmp_path / "a/lost").unlink()
    unreadable = ("error", "unreadable", 0)
    assert ledger_of(scan) == {
        "a/good": ("ok", None, 3),
        "a/lost": unreadable,
        "b/denied": unreadable,
        "b/late": unreadable,
        "b/zero": ("ok", None, 0),
    }
    # Records of the good part of a broken file are there, and are not accepted.
    assert scan.filter("file = 'b/late' and is_article").count() > 100
    assert {row["file"] for row in articles.accepted(scan).collect()} == {"a/good"}


def test_a_file_is_lost_in_some_of_its_splits(spark, tmp_path):
    path = folder_of(tmp_path, {"whole": LINE * 3000, "broken": LINE * 3000})
    break_at(tmp_path, "broken", len(LINE) * 2990)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = articles.scan_jsonl(spark, path)
        assert scan.rdd.getNumPartitions() > 10
        assert ledger_of(scan) == {"whole": ("ok", None, 3000), "broken": ("error", "unreadable", 0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("scan", [articles.scan_arrays, articles.scan_indented_arrays])
def test_arrays(spark, tmp_path, scan):
    content = json.dumps([{"title": "t", "text": "x" * 400}] * 3, indent=2)
    path = folder_of(tmp_path, {"a/good.json": content, "a/lost.json": content, "a/broken.json": content, "a/zero.json": ""})
    break_at(tmp_path, "a/broken.json", 512)
    found = scan(spark, path)
    (tmp_path / "a/lost.json").unlink()
    assert ledger_of(found) == {
        "a/good.json": ("ok", None, 3),
        "a/lost.json": ("error", "unreadable", 0),
        "a/broken.json": ("error", "unreadable", 0),
        "a/zero.json": ("error", "invalid JSON", 0),
    }


def test_audit(spark, tmp_path):
    path = folder_of(tmp_path, {"a/good.json": "[1, 2]", "a/lost.json": "[1]", "a/broken.json": "[1]", "a/zero.json": ""})
    break_at(tmp_path, "a/broken.json", 0)
    counts = articles.count_array_files(spark, path)
    (tmp_path / "a/lost.json").unlink()
    assert {row["file"]: (row["n_articles"], row["error"]) for row in counts.collect()} == {
        "a/good.json": (2, None),
        "a/lost.json": (None, "unreadable"),
        "a/broken.json": (None, "unreadable"),
        "a/zero.json": (None, "invalid JSON"),
    }


def test_every_end_of_line_counts_its_bytes(spark, tmp_path):
    """Line ends of all kinds, with and without one at the end, a byte order mark, and bytes that are no text."""
    rng, files, expected = random.Random(5), {}, {}
    for i in range(20):
        n, parts = rng.randrange(1, 6), [b"\xef\xbb\xbf" if rng.random() < 0.3 else b""]
        for _ in range(n):
            parts += [LINE.strip().encode(), rng.choice([b"\n", b"\r\n", b"\r", b"\n\n", b"\r\r\n"])]
        files[f"f{i}"] = b"".join(parts if rng.random() < 0.5 else parts[:-1])
        expected[f"f{i}"] = ("ok", None, n)
    files["latin"], expected["latin"] = b'{"text": "\xe9"}\r{"text": "y"}', ("error", "invalid JSON", 0)
    assert ledger_of(articles.scan_jsonl(spark, folder_of(tmp_path, files))) == expected


def test_compressed_files_are_read_or_fail(spark, tmp_path):
    packed = gzip.compress((LINE * 500).encode())
    path = folder_of(tmp_path / "good", {"a.gz": packed, "b": LINE})
    assert ledger_of(articles.scan_jsonl(spark, path)) == {"a.gz": ("ok", None, 500), "b": ("ok", None, 1)}
    path = folder_of(tmp_path / "cut", {"a.gz": packed[: len(packed) // 2]})
    with pytest.raises(Exception):
        ledger_of(articles.scan_jsonl(spark, path))


def test_reasons(spark, tmp_path):
    path = folder_of(tmp_path, {"a/denied": LINE, "a/broken": LINE, "good": LINE, "a/list": "[]\n"})
    break_at(tmp_path, "a/broken", 0)
    if os.geteuid():
        (tmp_path / "a/denied").chmod(0)
        expected = "permission"
    else:
        break_at(tmp_path, "a/denied", 0)
        expected = "unreadable"
    told = articles.with_reasons(articles.load_ledger(articles.scan_jsonl(spark, path)), path)
    assert {row["file"]: row["error"] for row in told.collect()} == {
        "a/denied": expected,
        "a/broken": "unreadable",
        "good": None,
        "a/list": "other",
    }


def test_the_cleaning_stage_keeps_what_can_be_read(spark, tmp_path):
    path = folder_of(tmp_path / "extracted", {"a/good": LINE * 3, "a/broken": LINE * 100})
    break_at(tmp_path / "extracted", "a/broken", 5_000)
    ledger = stages.clean(spark, path, str(tmp_path / "cleaned"))
    assert {row["file"]: row["error"] for row in ledger.collect()} == {"a/good": None, "a/broken": "unreadable"}
    assert stages.read_cleaned(spark, str(tmp_path / "cleaned")).count() == 3


def test_a_line_is_parsed_once(spark, tmp_path):
    """The records of a file's lines come from one parser in the plan; another one is only for lines that are no objects."""
    lines = spark.createDataFrame([(LINE, f"file:{tmp_path}/a")], "value string, file_path string")
    scan = articles.jsonl_records(lines, str(tmp_path)).filter("is_article")
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(StructType(") == 1, plan
