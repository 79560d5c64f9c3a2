"""Queries that write the given tables as files and read them back.

All files go below the session's shared folder. All given rows are written whole;
files with faults stand beside them, so that the rejection of files shows in the results.
"""

import functools

from pyspark.sql import functions as F

from lexmill.functions.cleaning import strip_nested_templates
from lexmill.operators import corpus, training_log
from lexmill.plans.inputs import SEQUENCES_SQL, SPLIT_SQL, char_sql, joined, sequences
from lexmill.session import new_shared_path
from lexmill.sources import array_splits, articles, metrics, sequences as stored, wiki_dump
from lexmill.sources.tables import read_table

# One array file holds the articles of one source in a range of this many ids.
_FILE_IDS = 1_000


def _record():
    return F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), "text"))


def _jsonl(spark, sf_dir):
    """JSON lines in one folder per source; beside them a folder of broken files, each with a good first line."""
    table = read_table(spark, sf_dir, "documents")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("title"), "text", "lang"))
    given = table.select(F.concat(record, F.lit("\n  ")).alias("value"), F.col("source").alias("folder"))
    good = F.lit('{"title": "x", "text": "y"}\n')
    broken = [("cut", '{"title": '), ("list", '["a"]'), ("number", '{"title": "a", "text": 5}')]
    added = [spark.range(1).select(F.concat(good, F.lit(line)).alias("value"), F.lit(name).alias("folder")) for name, line in broken]
    path = new_shared_path(spark, "extracted")
    functools.reduce(lambda a, b: a.unionByName(b), [given, *added]).write.partitionBy("folder").text(path)
    return path


def _array_files(spark, sf_dir, record, separator):
    """One row per file: the records of one source in a range of ids."""
    return (
        read_table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("folder"), F.floor(F.col("doc_id") / _FILE_IDS))
        .agg(F.array_join(F.collect_list(record), separator).alias("records"))
    )


def _arrays(spark, sf_dir):
    """Array files, one folder per source. Beside them: one cut short, objects with and without a list,
    one whose records lack a text, one with a scalar, one that says its text twice, and one of zero bytes."""
    given = _array_files(spark, sf_dir, _record(), ",\n").select(
        F.concat(F.lit("["), "records", F.lit("]")).alias("value"), "folder"
    )
    added = spark.createDataFrame(
        [
            ('[{"title": "c", "text": "x"}', "cut"),
            ('{"v": 1, "articles": [{"title": "o", "text": "x"}]}', "object"),
            ('{"articles": "none"}', "none"),
            ('[{"title": "l"}, {"title": "m", "text": "kept"}]', "lacking"),
            ('["abc", {"title": "s", "text": "beside a scalar"}]', "scalar"),
        ],
        "value string, folder string",
    )
    path = new_shared_path(spark, "cleaned")
    # One row per file: an array file is one JSON value.
    files = given.unionByName(added)
    files.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    # A text file of no lines has zero bytes.
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{path}/folder=zero")
    return path


def indented_arrays(spark, sf_dir):
    """Array files in the indented layout, read in splits; beside them one that is not closed."""
    fields = _record()
    record = F.concat(F.lit("\n  {\n    "), F.substring(fields, F.lit(2), F.length(fields) - 2), F.lit("\n  }"))
    given = _array_files(spark, sf_dir, record, ",").select(
        F.concat(F.lit("["), "records", F.lit("\n]")).alias("value"), "folder"
    )
    added = spark.createDataFrame([('[\n  {\n    "title": "c", "text": "x"\n  }', "open")], "value string, folder string")
    path = new_shared_path(spark, "indented")
    files = given.unionByName(added)
    files.write.partitionBy("folder").option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    read = articles.read_article_arrays(spark, path, glob="*.txt", indented=True)
    return read.select(_source().alias("source"), "title", "text")


def sequence_arrays(spark, sf_dir):
    """Id arrays in one JSON array per file."""
    clipped = corpus.truncate_tokens(sequences(spark, sf_dir))
    grouped = clipped.groupBy("source", F.floor(F.col("doc_id") / _FILE_IDS)).agg(F.collect_list("tokens").alias("all"))
    path = new_shared_path(spark, "sequences")
    grouped.select(F.to_json("all").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return stored.read_sequence_json(spark, path).select(joined("tokens").alias("tokens"))


def article_arrays_split(spark, sf_dir):
    """Array files of any layout, read in splits."""
    read = array_splits.read_split_arrays(spark, _arrays(spark, sf_dir), glob="*.txt")
    return read.select(_source().alias("source"), "title", "text")


def split_ledger(spark, sf_dir):
    """The strict ledger of array files that are read in splits."""
    return _by_source(articles.load_ledger(array_splits.scan_split_arrays(spark, _arrays(spark, sf_dir), "strict", glob="*.txt")))


def array_split_audit(spark, sf_dir):
    """The audit of array files that are read in splits."""
    counts = array_splits.count_split_files(spark, _arrays(spark, sf_dir), glob="*.txt")
    return counts.groupBy(_source().alias("source"), "error").agg(
        F.sum("n_articles").alias("articles"), F.count("*").alias("files")
    )


def _source(folder="folder"):
    return F.substring_index(folder, "=", -1)


def jsonl_articles(spark, sf_dir):
    read = articles.read_jsonl_articles(spark, _jsonl(spark, sf_dir))
    return read.select(_source().alias("source"), "title", "text")


def article_arrays(mode):
    def query(spark, sf_dir):
        read = articles.read_article_arrays(spark, _arrays(spark, sf_dir), mode, glob="*.txt")
        return read.select(_source().alias("source"), "title", "text")

    return query


def _by_source(ledger):
    return ledger.groupBy(_source().alias("source"), "status", "error").agg(F.sum("n_articles").alias("articles"))


def load_ledger(spark, sf_dir):
    return _by_source(articles.load_ledger(articles.scan_jsonl(spark, _jsonl(spark, sf_dir))))


def strict_ledger(spark, sf_dir):
    scan = articles.scan_arrays(spark, _arrays(spark, sf_dir), "strict", glob="*.txt")
    return _by_source(articles.load_ledger(scan))


def ledger_totals(spark, sf_dir):
    scan = articles.scan_arrays(spark, _arrays(spark, sf_dir), glob="*.txt")
    return articles.ledger_totals(articles.load_ledger(scan))


def array_file_audit(spark, sf_dir):
    counts = articles.count_array_files(spark, _arrays(spark, sf_dir), glob="*.txt")
    return counts.groupBy(_source().alias("source"), "error").agg(
        F.sum("n_articles").alias("articles"), F.count("*").alias("files")
    )


def cleaned_sink(spark, sf_dir):
    path = new_shared_path(spark, "cleaned")
    read = articles.read_jsonl_articles(spark, _jsonl(spark, sf_dir))
    articles.write_cleaned(corpus.clean_articles(read), path)
    return spark.read.parquet(path).select(_source().alias("source"), "title", "text")


def split_sink(spark, sf_dir):
    path = new_shared_path(spark, "splits")
    built = corpus.split_corpus(corpus.truncate_tokens(sequences(spark, sf_dir)), "doc_id")
    stored.write_splits(built, path)
    return stored.read_sequences(spark, path).select("doc_id", "split", joined("tokens").alias("tokens"))


def stored_metrics(spark, sf_dir):
    path = new_shared_path(spark, "metrics")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select(
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").cast("int").alias("step"),
        F.col("value").alias("loss"),
        F.col("user_id").alias("num_tokens"),
        F.lit(0.0002).alias("lr"),
        F.lit(0.5).alias("step_seconds"),
    ).write.json(path)
    log = metrics.read_metrics(spark, path, metrics.STEP_SCHEMA, "json")
    return training_log.weighted_loss(log, "epoch").select(
        F.col("epoch").cast("bigint").alias("epoch"), F.round("loss", 6).alias("loss"), "num_tokens"
    )


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


_NESTED = "{{Infobox\n| a = {{b|{{c}}}}\n}}"


def _dump(spark, sf_dir):
    """A bz2 dump of the documents, with nested templates; beside them a page of another namespace, a redirect and a broken page."""

    def page(title, ns, number, redirect, text, end="</text>\n    </revision>\n  </page>"):
        return F.concat(
            F.lit("  <page>\n    <title>"), title, F.lit(f"</title>\n    <ns>{ns}</ns>\n    <id>"), number.cast("string"),
            F.lit(f'</id>\n{redirect}    <revision>\n      <id>1</id>\n      <text bytes="1" xml:space="preserve">'),
            _escaped(text), F.lit(end),
        ).alias("value")

    text = F.concat(F.lit(_NESTED), "text", F.lit(" <ref>a & b</ref> {{open "))
    given = read_table(spark, sf_dir, "documents").select(page(F.concat_ws("-", "source", "lang"), 0, F.col("doc_id"), "", text))
    one = spark.range(1)
    added = [
        one.select(page(F.lit("Aide"), 14, F.lit(-1), "", F.lit("x"))),
        one.select(page(F.lit("Vers"), 0, F.lit(-2), '    <redirect title="x" />\n', F.lit("x"))),
        one.select(page(F.lit("Faux"), 0, F.lit(-3), "", F.lit("x"), "</txt>\n    </revision>\n  </page>")),
    ]
    path = new_shared_path(spark, "raw")
    pages = functools.reduce(lambda a, b: a.unionByName(b), [given, *added])
    pages.write.option("compression", "bzip2").text(path)
    return path


def wiki_articles(spark, sf_dir):
    return wiki_dump.read_wiki_dump(spark, _dump(spark, sf_dir)).select("page_id", "title", "text")


def wiki_plain(spark, sf_dir):
    """Article texts without templates, nested ones and those of several lines too."""
    pages = wiki_dump.read_wiki_dump(spark, _dump(spark, sf_dir))
    return pages.select("page_id", strip_nested_templates("text").alias("text"))


def wiki_ledger(spark, sf_dir):
    return wiki_dump.dump_ledger(wiki_dump.scan_wiki_dump(spark, _dump(spark, sf_dir)))


QUERIES = {
    "wiki_articles": wiki_articles,
    "wiki_plain": wiki_plain,
    "wiki_ledger": wiki_ledger,
    "jsonl_articles": jsonl_articles,
    "article_arrays_lenient": article_arrays("lenient"),
    "article_arrays_strict": article_arrays("strict"),
    "article_arrays_indented": indented_arrays,
    "article_arrays_split": article_arrays_split,
    "split_ledger": split_ledger,
    "array_split_audit": array_split_audit,
    "sequence_arrays": sequence_arrays,
    "load_ledger": load_ledger,
    "strict_ledger": strict_ledger,
    "ledger_totals": ledger_totals,
    "array_file_audit": array_file_audit,
    "cleaned_sink": cleaned_sink,
    "split_sink": split_sink,
    "stored_metrics": stored_metrics,
}

_TITLED = "SELECT source, doc_id::VARCHAR AS title, text FROM documents"

# Rows that the added files give.
_LENIENT_ADDED = "(VALUES ('lacking', 'm', 'kept'), ('scalar', 's', 'beside a scalar'))"
_FILES = f"(SELECT DISTINCT source, doc_id // {_FILE_IDS} FROM documents)"

ORACLES = {
    "article_arrays_indented": _TITLED,
    "sequence_arrays": f"SELECT array_to_string(tokens[1:512], ' ') AS tokens FROM ({SEQUENCES_SQL})",
    "wiki_articles": (
        "SELECT doc_id AS page_id, source || '-' || lang AS title,"
        f" {char_sql(_NESTED)} || text || ' <ref>a & b</ref> {{{{open ' AS text FROM documents"
    ),
    "wiki_plain": "SELECT doc_id AS page_id, text || ' <ref>a & b</ref> {{open ' AS text FROM documents",
    "wiki_ledger": (
        "SELECT 'article' AS status, 0 AS ns, count(*) AS pages FROM documents"
        " UNION ALL SELECT * FROM (VALUES ('article', 14, 1), ('redirect', 0, 1), ('malformed', NULL, 1))"
    ),
    "jsonl_articles": _TITLED,
    "article_arrays_lenient": f"{_TITLED} UNION ALL SELECT * FROM {_LENIENT_ADDED}",
    "article_arrays_strict": _TITLED,
    "load_ledger": (
        "SELECT source, 'ok' AS status, NULL AS error, count(*) AS articles FROM documents GROUP BY source"
        " UNION ALL SELECT * FROM (VALUES ('cut', 'error', 'invalid JSON', 0), ('list', 'error', 'other', 0),"
        " ('number', 'error', 'other', 0))"
    ),
    "strict_ledger": (
        "SELECT source, 'ok' AS status, NULL AS error, count(*) AS articles FROM documents GROUP BY source"
        " UNION ALL SELECT * FROM (VALUES ('cut', 'error', 'invalid JSON', 0), ('object', 'error', 'other', 0),"
        " ('none', 'error', 'other', 0), ('lacking', 'error', 'other', 0), ('scalar', 'error', 'other', 0),"
        " ('zero', 'error', 'invalid JSON', 0))"
    ),
    "ledger_totals": (
        "SELECT count(*) + 2 AS articles, (SELECT count(*) + 4 FROM " + _FILES + ") AS files, 2 AS errors FROM documents"
    ),
    "array_file_audit": (
        "SELECT source, NULL AS error, count(*) AS articles,"
        f" count(DISTINCT doc_id // {_FILE_IDS}) AS files FROM documents GROUP BY source"
        " UNION ALL SELECT * FROM (VALUES ('cut', 'invalid JSON', NULL, 1), ('object', NULL, 1, 1),"
        " ('none', 'structure not recognised', NULL, 1), ('lacking', NULL, 2, 1), ('scalar', NULL, 2, 1),"
        " ('zero', 'invalid JSON', NULL, 1))"
    ),
    "cleaned_sink": (
        "SELECT source, doc_id::VARCHAR AS title, trim(lower(regexp_replace(text, '==[^\\n]*?==', '', 'g')),"
        " ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents"
    ),
    "split_sink": (
        f"SELECT doc_id, {SPLIT_SQL} AS split, array_to_string(tokens[1:512], ' ') AS tokens FROM ({SEQUENCES_SQL})"
    ),
    "stored_metrics": (
        "SELECT day(ts) AS epoch, round(sum(value * user_id) / sum(user_id), 6) AS loss,"
        " sum(user_id)::BIGINT AS num_tokens FROM events GROUP BY day(ts)"
    ),
}
ORACLES |= {
    "article_arrays_split": ORACLES["article_arrays_lenient"],
    "split_ledger": ORACLES["strict_ledger"],
    "array_split_audit": ORACLES["array_file_audit"],
}
