import bz2
import json
import random

import pytest

from lexmill.operators import audit
from lexmill.plans import stages
from lexmill.sources import articles, metrics, sequences, wiki_dump
from lexmill.sources.wiki_dump import read_wiki_dump
from lexmill.streaming.clean_files import clean_new_files


def write(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def rows(df, *names):
    return sorted(tuple(row[name] for name in names) for row in df.collect())


def line(**record):
    return json.dumps(record, ensure_ascii=False) + "\n"


@pytest.fixture
def extracted(tmp_path):
    return write(
        tmp_path / "extracted",
        {
            "AA/wiki_00": line(title="A", text="Été ==x== b", id=1) + "\n   \n" + line(title="B"),
            "AA/wiki_01.txt": line(title="C", text="c") + '{"title": "D", "te\n',
            "BB/CC/wiki 02+x": line(text="no title") + line(title="E", text=None),
            "BB/two": '{"title": "F"} {"title": "G"}\n',
            "BB/list": '["text"]\n',
            "BB/latin": b'{"text": "\xe9"}\n',
            "BB/blank": "\n  \n",
            "top": line(title="T", text=" {{x}} Top "),
        },
    )


def test_json_lines(spark, extracted):
    read = articles.read_jsonl_articles(spark, extracted)
    assert rows(read, "file", "folder", "title", "text") == [
        ("AA/wiki_00", "AA", "A", "Été ==x== b"),
        ("AA/wiki_00", "AA", "B", ""),
        ("BB/CC/wiki 02+x", "BB/CC", "", "no title"),
        ("BB/CC/wiki 02+x", "BB/CC", "E", ""),
        ("top", ".", "T", " {{x}} Top "),
    ]


def test_json_lines_ledger(spark, extracted):
    scan = articles.scan_jsonl(spark, extracted)
    ledger = articles.load_ledger(scan)
    got = {row["file"]: (row["status"], row["error"], row["n_articles"], row["null_texts"]) for row in ledger.collect()}
    assert got == {
        "AA/wiki_00": ("ok", None, 2, 1),
        "AA/wiki_01.txt": ("error", "invalid JSON", 0, 0),
        "BB/CC/wiki 02+x": ("ok", None, 2, 1),
        "BB/two": ("error", "invalid JSON", 0, 0),
        "BB/list": ("error", "other", 0, 0),
        "BB/latin": ("error", "invalid JSON", 0, 0),
        "BB/blank": ("ok", None, 0, 0),
        "top": ("ok", None, 1, 0),
    }
    assert articles.ledger_totals(ledger).collect()[0].asDict() == {"articles": 5, "files": 4, "errors": 4}


def test_many_rejected_files_are_joined_instead_of_broadcast(spark, extracted, monkeypatch):
    expected = rows(articles.read_jsonl_articles(spark, extracted), "file", "title")
    monkeypatch.setattr(articles, "MAX_BROADCAST_FILES", 0)
    assert rows(articles.read_jsonl_articles(spark, extracted), "file", "title") == expected


ARRAYS = {
    "AA/full.json": json.dumps([{"title": "A", "text": "a"}, {"title": "B", "text": "b"}], indent=2),
    "AA/partial.json": '[{"title": "C"}, {"text": "d"}, {"text": null}]',
    "AA/empty.json": "[]",
    "AA/cut.json": '[{"text": "e"}',
    "AA/twice.json": '[{"text": "e"}] [{"text": "f"}]',
    "AA/twice_closed.json": '[{"text": "e"}]],[[{"text": "f"}]',
    "AA/object.json": '{"n": 1, "s": "[1]", "items": [1, 2, 3], "more": [1]}',
    "AA/nothing.json": '{"n": 1}',
    "AA/blank_object.json": "{ }",
    "AA/scalars.json": '[{"text": "g"}, 5]',
    "AA/number.json": "5",
    "AA/quotes.json": "[{'text': 'h'}]",
    "AA/skipped.txt": '[{"text": "x"}]',
    "AA/deep/er.json": '[{"text": "deep"}]',
    "top.json": '[{"text": "top"}]',
}


def test_arrays_lenient(spark, tmp_path):
    path = write(tmp_path / "cleaned", ARRAYS)
    read = articles.read_article_arrays(spark, path)
    assert rows(read, "file", "text") == [
        ("AA/deep/er.json", "deep"),
        ("AA/full.json", "a"),
        ("AA/full.json", "b"),
        ("AA/partial.json", "d"),
        ("top.json", "top"),
    ]
    ledger = articles.load_ledger(articles.scan_arrays(spark, path))
    failed = rows(ledger.filter("status = 'error'"), "file", "error")
    assert failed == [
        ("AA/cut.json", "invalid JSON"),
        ("AA/quotes.json", "invalid JSON"),
        ("AA/scalars.json", "other"),
        ("AA/twice.json", "invalid JSON"),
        ("AA/twice_closed.json", "invalid JSON"),
    ]
    assert rows(ledger.filter("null_texts > 0"), "file", "null_texts") == [("AA/partial.json", 1)]
    assert articles.ledger_totals(ledger).collect()[0]["files"] == len(ARRAYS) - 1 - 5


def test_arrays_strict(spark, tmp_path):
    path = write(tmp_path / "cleaned", ARRAYS)
    read = articles.read_article_arrays(spark, path, "strict")
    assert rows(read, "file", "text") == [
        ("AA/deep/er.json", "deep"),
        ("AA/full.json", "a"),
        ("AA/full.json", "b"),
        ("top.json", "top"),
    ]
    ledger = articles.load_ledger(articles.scan_arrays(spark, path, "strict"))
    assert rows(ledger.filter("status = 'ok'"), "file", "n_articles") == [
        ("AA/blank_object.json", 0),
        ("AA/deep/er.json", 1),
        ("AA/empty.json", 0),
        ("AA/full.json", 2),
        ("top.json", 1),
    ]
    with pytest.raises(ValueError):
        articles.scan_arrays(spark, path, "loose")


def test_audit_of_array_files(spark, tmp_path):
    path = write(tmp_path / "cleaned", ARRAYS)
    counts = articles.count_array_files(spark, path)
    assert {row["file"]: (row["n_articles"], row["error"]) for row in counts.collect()} == {
        "AA/full.json": (2, None),
        "AA/partial.json": (3, None),
        "AA/empty.json": (0, None),
        "AA/cut.json": (None, "invalid JSON"),
        "AA/twice.json": (None, "invalid JSON"),
        "AA/twice_closed.json": (None, "invalid JSON"),
        "AA/object.json": (3, None),
        "AA/nothing.json": (None, "structure not recognised"),
        "AA/blank_object.json": (None, "structure not recognised"),
        "AA/scalars.json": (2, None),
        "AA/number.json": (None, "other"),
        "AA/quotes.json": (None, "invalid JSON"),
    }
    totals, folders, ranked = stages.audit_cleaned(spark, path, k=2)
    assert totals.collect()[0].asDict() == {
        "articles": 10,
        "files": 12,
        "max_articles": 3,
        "min_articles": 0,
        "mean_articles": 10 / 12,
    }
    assert rows(folders, "folder", "articles", "files") == [("AA", 10, 5)]
    assert [row["file"] for row in ranked.collect()] == ["AA/object.json", "AA/partial.json"]


def test_audit_without_countable_files(spark):
    counts = spark.createDataFrame([("f", "d", None, "invalid JSON")], "file string, folder string, n_articles bigint, error string")
    row = audit.audit_totals(counts).collect()[0]
    assert (row["articles"], row["files"], row["max_articles"], row["mean_articles"]) == (0, 1, None, 0.0)


def test_require_nonempty(spark):
    with pytest.raises(ValueError):
        articles.require_nonempty(spark.createDataFrame([], "text string"))


def page(title, text, page_id, ns=0, extra="", attributes=' bytes="3" xml:space="preserve"'):
    return (
        f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n    <id>{page_id}</id>\n{extra}"
        f"    <revision>\n      <id>{page_id}0</id>\n      <text{attributes}>{text}</text>\n    </revision>\n  </page>\n"
    )


@pytest.mark.parametrize("compress", [False, True])
def test_wiki_dump(spark, tmp_path, compress):
    dump = (
        '<mediawiki xml:lang="fr">\n  <siteinfo><sitename>W</sitename></siteinfo>\n'
        + page("A &amp; B", " l'été &lt;ref&gt;\n\n{{x}} ", 1)
        + page("R", "#REDIRECT", 2, extra='    <redirect title="A" />\n')
        + page("Discussion:A", "talk", 3, ns=1)
        + page("Vide", "", 4)
        + page("Plain", "p", 5, attributes="")
        + "</mediawiki>\n"
    )
    name = "dump.xml.bz2" if compress else "dump.xml"
    path = tmp_path / name
    path.write_bytes(bz2.compress(dump.encode()) if compress else dump.encode())
    assert rows(read_wiki_dump(spark, str(path)), "page_id", "revision_id", "title", "text") == [
        (1, 10, "A & B", " l'été <ref>\n\n{{x}} "),
        (4, 40, "Vide", ""),
        (5, 50, "Plain", "p"),
    ]
    assert read_wiki_dump(spark, str(path), namespaces=None).count() == 4


def test_sequence_files(spark, tmp_path):
    df = spark.createDataFrame([("train", [1, 2]), ("val", [])], "split string, tokens array<int>")
    sequences.write_splits(df, f"{tmp_path}/seq")
    assert rows(sequences.read_sequences(spark, f"{tmp_path}/seq", "train"), "tokens") == [([1, 2],)]


@pytest.fixture
def small_splits(spark):
    """Force several splits per file, so that records cross their borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "64")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_sequence_arrays(spark, tmp_path, small_splits):
    ids = [list(range(i, 2 * i)) for i in range(40)] + [[]]
    path = write(tmp_path / "a", {"train.json": json.dumps(ids)})
    read = sequences.read_sequence_json(spark, path)
    assert read.rdd.getNumPartitions() > 3
    assert [row["tokens"] for row in read.orderBy("part", "block", "row").collect()] == ids
    assert sequences.read_sequence_json(spark, write(tmp_path / "b", {"val.json": "[]\n"})).count() == 0
    for name, broken in (("c", "[[1, 2], [3"), ("d", "[[1], [2]")):
        with pytest.raises(ValueError):
            sequences.read_sequence_json(spark, write(tmp_path / name, {"x.json": broken}))
    with pytest.raises(Exception, match="not an array of ids"):
        sequences.read_sequence_json(spark, write(tmp_path / "e", {"x.json": '[["a"], [1]]'})).collect()


def indented(records):
    return json.dumps(records, ensure_ascii=False, indent=2)


INDENTED = {
    "AA/many.json": indented([{"title": f"T{i}", "text": "é { } \n  }\n]" * i, "tags": [{"a": {"b": 1}}]} for i in range(60)]),
    "AA/empty.json": "[]",
    "AA/partial.json": indented([{"title": "C"}, {"text": "d"}, {"text": None}]),
    "BB/cut.json": indented([{"text": "e"}, {"text": "f"}])[:-2],
    "BB/cut_inside.json": indented([{"text": "g"}, {"text": "h"}])[:-9],
    "BB/compact.json": '[{"text": "i"}]',
    "BB/wrong.json": indented([{"text": "j"}]).replace('"j"', "j"),
}


@pytest.mark.parametrize("mode", ["lenient", "strict"])
def test_indented_arrays_read_in_splits(spark, tmp_path, small_splits, mode):
    path = write(tmp_path / "cleaned", INDENTED)
    read = articles.read_article_arrays(spark, path, mode, indented=True)
    kept = {name: json.loads(INDENTED[name]) for name in ("AA/many.json", "AA/partial.json")}
    if mode == "strict":
        del kept["AA/partial.json"]
    assert rows(read, "file", "text") == sorted(
        (name, record["text"]) for name, records in kept.items() for record in records if record.get("text") is not None
    )
    ledger = articles.load_ledger(articles.scan_indented_arrays(spark, path, mode))
    errors = {row["file"]: row["error"] for row in ledger.filter("status = 'error'").collect()}
    expected = dict.fromkeys(name for name in INDENTED if name.startswith("BB/"))
    assert errors.keys() == expected.keys() | ({"AA/partial.json"} if mode == "strict" else set())
    assert {error for name, error in errors.items() if name.startswith("BB/")} == {"invalid JSON"}
    assert ledger.filter("file = 'AA/empty.json'").collect()[0]["n_articles"] == 0


def test_metrics_have_a_fixed_schema(spark, tmp_path):
    (tmp_path / "epochs.json").write_text('{"epoch": 0, "val_loss": 1, "other": "x"}\n')
    row = metrics.read_metrics(spark, str(tmp_path), metrics.EPOCH_SCHEMA, "json").collect()[0]
    assert row.asDict() == {
        "epoch": 0,
        "train_loss": None,
        "val_loss": 1.0,
        "epoch_seconds": None,
        "val_seconds": None,
    }


def test_stages_end_to_end(spark, tmp_path):
    text = "le chat dort et le chien court dans le jardin " * 3
    pages = "".join(page(f"P{i % 30}", f"{{{{x}}}}{text}{i % 30}", i) for i in range(40))
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
    at = lambda name: f"{tmp_path}/{name}"
    stages.extract(spark, at("dump.xml"), at("extracted"))
    ledger = stages.clean(spark, at("extracted"), at("cleaned"))
    assert articles.ledger_totals(ledger).collect()[0]["articles"] == 40
    stages.learn_tokenizer(spark, at("cleaned"), at("tokenizer"), vocab_size=80)
    stats, shares = stages.build_corpus(spark, at("cleaned"), at("tokenizer"), at("sequences"))
    assert stats.collect()[0]["articles"] == 40
    assert sum(row["samples"] for row in shares.collect()) == 40
    train = {row["split"]: row["samples"] for row in shares.collect()}["train"]
    in_order = stages.training_batches(spark, at("sequences"), "train")
    shuffled = stages.training_batches(spark, at("sequences"), "train", epoch=2)
    for built in (in_order, shuffled):
        collected = built.collect()
        assert sum(len(row["rows"]) for row in collected) == train
        assert all(len(ids) == row["width"] for row in collected for ids in row["rows"])


def test_new_files_are_cleaned_once(spark, tmp_path):
    source = write(tmp_path / "in", {"AA/one": line(title="A", text=" X ==h== "), "AA/bad": "{\n"})
    target, checkpoint = f"{tmp_path}/out", f"{tmp_path}/state"
    clean_new_files(spark, source, target, checkpoint)
    assert rows(spark.read.parquet(target), "title", "text") == [("A", "x")]
    write(tmp_path / "in", {"BB/two": line(title="B", text="Y")})
    clean_new_files(spark, source, target, checkpoint)
    clean_new_files(spark, source, target, checkpoint)
    assert rows(spark.read.parquet(target), "title", "text", "folder") == [("A", "x", "AA"), ("B", "y", "BB")]


@pytest.mark.parametrize("spelling", ["{}", "file://{}", "{}/", "{}/../extracted", "{}//"])
def test_any_spelling_of_a_folder(spark, extracted, spelling):
    read = articles.read_jsonl_articles(spark, spelling.format(extracted).replace("/extracted", "//extracted"))
    assert rows(read, "file", "folder", "title")[0] == ("AA/wiki_00", "AA", "A")


def test_relative_folder(spark, extracted):
    import os

    relative = "./" + os.path.relpath(extracted, spark.sparkContext._jvm.java.lang.System.getProperty("user.dir"))
    assert articles.read_jsonl_articles(spark, relative).count() == 5


def test_a_file_elsewhere_is_an_error(spark, extracted):
    lines = spark.createDataFrame([("{}", "file:///elsewhere/a")], "value string, file_path string")
    with pytest.raises(Exception, match="not below"):
        articles.jsonl_records(lines, extracted).collect()


def test_text_that_is_no_string_rejects_the_file(spark, tmp_path):
    path = write(tmp_path / "x", {"a": '{"text": 5}\n', "b": '{"text": ["x"]}\n', "c": '{"text": null, "title": "n"}\n'})
    assert rows(articles.read_jsonl_articles(spark, path), "file", "title", "text") == [("c", "n", "")]


def test_files_of_zero_bytes(spark, tmp_path):
    path = write(tmp_path / "x", {"AA/a.json": "", "AA/b.json": "[]", "AA/_hidden.json": "", "AA/a.txt": ""})
    ledger = articles.load_ledger(articles.scan_arrays(spark, path))
    assert rows(ledger, "file", "status") == [("AA/a.json", "error"), ("AA/b.json", "ok")]
    assert rows(articles.count_array_files(spark, path).na.fill(-1), "file", "n_articles") == [("AA/a.json", -1), ("AA/b.json", 0)]
    lines = articles.load_ledger(articles.scan_jsonl(spark, path))
    assert ("AA/a.txt", "ok", 0) in rows(lines, "file", "status", "n_articles")


def test_files_of_zero_bytes_are_told_from_one_listing(spark, tmp_path):
    """Names that Spark encodes are found; a file lost since it was listed is none of zero bytes."""
    odd = "A A/é+%20 #1.json"
    path = write(tmp_path / "x", {odd: "", "AA/lost.json": "", "AA/gone.json": "[]", "AA/b.json": "[]", "AA/.hidden.json": "", "k=_1/c.json": ""})
    listing = articles._listing(spark, path, "*.json")
    (tmp_path / "x/AA/lost.json").unlink()
    (tmp_path / "x/AA/gone.json").unlink()
    found = articles.empty_files(spark, path, "*.json", listing)
    assert rows(found, "file", "folder") == [(odd, "A A"), ("k=_1/c.json", "k=_1")]


def test_scalars_and_repeated_keys_in_arrays(spark, tmp_path):
    path = write(
        tmp_path / "x",
        {"s.json": '["abc", ["d"], {"text": "x"}]', "r.json": '[{"text": "first", "text": "last"}]', "n.json": '[null, {"text": "y"}]'},
    )
    assert rows(articles.read_article_arrays(spark, path), "file", "text") == [("r.json", "last"), ("s.json", "x")]
    assert rows(articles.read_article_arrays(spark, path, "strict"), "file", "text") == [("r.json", "last")]


def test_malformed_pages_are_counted(spark, tmp_path):
    page = "<page><title>{}</title><ns>0</ns><id>{}</id><revision><id>1</id><text>x</text></revision></page>\n"
    dump = "<mediawiki>\n" + page.format("a", 1) + page.format("b", 2).replace("</title>", "</titel>") + page.format("c", 3) + "</mediawiki>\n"
    path = write(tmp_path / "raw", {"d.xml.bz2": bz2.compress(dump.encode())})
    scan = wiki_dump.scan_wiki_dump(spark, path)
    assert rows(wiki_dump.dump_ledger(scan).na.fill(-1), "status", "ns", "pages") == [("article", 0, 2), ("malformed", -1, 1)]
    assert "titel" in scan.filter("malformed IS NOT NULL").collect()[0]["malformed"]
    assert rows(read_wiki_dump(spark, path, namespaces=None), "page_id", "title") == [(1, "a"), (3, "c")]


def test_a_compressed_dump_is_read_in_splits(spark, tmp_path):
    """Every page once, although the file is cut at places that know nothing of pages."""
    rng = random.Random(1)
    page = "<page><title>{0}</title><ns>0</ns><id>{0}</id><revision><id>1</id><text>{1}</text></revision></page>\n"
    dump = "<mediawiki>\n" + "".join(page.format(i, "".join(rng.choices("abcdefghij ", k=600))) for i in range(3000)) + "</mediawiki>\n"
    path = write(tmp_path / "raw", {"d.xml.bz2": bz2.compress(dump.encode(), 1)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = read_wiki_dump(spark, path)
        assert read.rdd.getNumPartitions() > 3
        assert sorted(row["page_id"] for row in read.select("page_id").collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
