"""Queries over id sequences: corpus building, batches and the article audit."""

import functools

from pyspark.sql import functions as F

from lexmill.functions.sequences import pad_min
from lexmill.operators import audit, batches, corpus
from lexmill.plans.inputs import SEQUENCES_SQL, SPLIT_SQL, joined, sequences, word_ids, word_ids_sql
from lexmill.plans.token_queries import full_sequences
from lexmill.sources.tables import read_table


def _built(spark, sf_dir, given=sequences):
    return corpus.split_corpus(corpus.truncate_tokens(given(spark, sf_dir)), "doc_id")


_BUILT_SQL = (
    f"SELECT doc_id, lang, source, {SPLIT_SQL} AS split, len(tokens) AS token_count, len(tokens) > 512 AS truncated,"
    f" tokens[1:512] AS tokens FROM ({SEQUENCES_SQL})"
)


def truncate_tokens(spark, sf_dir, given=sequences):
    return corpus.truncate_tokens(given(spark, sf_dir)).select(
        "doc_id", F.col("token_count").cast("bigint").alias("token_count"), "truncated", joined("tokens").alias("tokens")
    )


def corpus_stats(spark, sf_dir, given=sequences):
    stats = corpus.corpus_stats(_built(spark, sf_dir, given))
    return stats.select(
        "articles",
        "truncated_articles",
        F.round("truncated_pct", 6).alias("truncated_pct"),
        F.round("mean_tokens", 6).alias("mean_tokens"),
        *[F.col(name).cast("bigint").alias(name) for name in ("min_tokens", "max_tokens", "total_tokens")],
    )


def split_corpus(spark, sf_dir, given=sequences):
    return _built(spark, sf_dir, given).select("doc_id", "split")


def split_shares(spark, sf_dir, given=sequences):
    return corpus.split_shares(_built(spark, sf_dir, given)).withColumn("pct", F.round("pct", 6))


def _short(spark, sf_dir, given=sequences):
    """Batches by language of the truncated sequences; the first ones hold only short sequences."""
    return batches.assign_batches(corpus.truncate_tokens(given(spark, sf_dir)), ["lang", "doc_id"])


_SHORT_SQL = (
    "SELECT *, (row_number() OVER (ORDER BY lang, doc_id) - 1) // 8 AS batch_id,"
    " (row_number() OVER (ORDER BY lang, doc_id) - 1) % 8 AS pos FROM (SELECT doc_id, lang,"
    f" tokens[1:512] AS tokens FROM ({SEQUENCES_SQL}))"
)
# Padding in SQL: valid rows get zeros up to the widest row of their batch.
_COLLATED_SQL = (
    "SELECT b.batch_id, pos, tokens, CASE WHEN width IS NULL THEN 2 ELSE width END AS width FROM"
    f" (SELECT batch_id, max(len(tokens)) FILTER (len(tokens) >= 2) AS width FROM ({_SHORT_SQL}) GROUP BY batch_id) b"
    f" LEFT JOIN (SELECT * FROM ({_SHORT_SQL}) WHERE len(tokens) >= 2) r ON b.batch_id = r.batch_id"
)
_PADDED_SQL = (
    "SELECT batch_id, width, row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS pos,"
    " CASE WHEN tokens IS NULL THEN [0, 0] ELSE list_resize(tokens, width, 0) END AS tokens"
    f" FROM ({_COLLATED_SQL})"
)


def collate(spark, sf_dir, given=sequences):
    rows = F.array_join(F.transform("rows", joined), ";")
    return batches.collate(_short(spark, sf_dir, given)).select(
        "batch_id", F.col("width").cast("bigint").alias("width"), rows.alias("rows")
    )


def batch_rows(spark, sf_dir, given=sequences):
    rows = batches.batch_rows(batches.collate(_short(spark, sf_dir, given)))
    return rows.select("batch_id", F.col("pos").cast("bigint").alias("pos"), joined("tokens").alias("tokens"))


def shift_pairs(spark, sf_dir, given=sequences):
    pairs = batches.shift_pairs(batches.batch_rows(batches.collate(_short(spark, sf_dir, given))))
    return pairs.select(
        "batch_id",
        F.col("pos").cast("bigint").alias("pos"),
        joined("input_ids").alias("input_ids"),
        joined("target_ids").alias("target_ids"),
    )


def _assigned(df):
    return df.select("doc_id", "batch_id", F.col("pos").cast("bigint").alias("pos"))


def assign_batches(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return _assigned(batches.assign_batches(documents, "doc_id"))


def shuffle_rows(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return _assigned(batches.shuffle_rows(documents, "doc_id", epoch=1, seed=7))


def _turns(spark, sf_dir):
    """Ids of whole turns, and beside them turns without an id and with one."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", word_ids("text").alias("tokens"))
    added = spark.range(6).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.slice(F.array(F.lit(8), F.lit(9)), 1, (F.col("id") % 3).cast("int")).alias("tokens"),
    )
    return turns.unionByName(added)


def filter_short(spark, sf_dir):
    return batches.filter_short(_turns(spark, sf_dir)).select("conv_id", "turn", joined("tokens").alias("tokens"))


def short_counts(spark, sf_dir):
    return batches.short_counts(_turns(spark, sf_dir))


def pad_min_rows(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", word_ids("text").alias("tokens"))
    return turns.select("conv_id", "turn", joined(pad_min("tokens", 64)).alias("tokens"))


def dataset_summary(spark, sf_dir, given=sequences):
    return batches.dataset_summary(batches.filter_short(_built(spark, sf_dir, given)))


def preview(spark, sf_dir, given=sequences):
    val = batches.filter_short(_built(spark, sf_dir, given).filter(F.col("split") == "val"))
    return batches.preview(val, "doc_id").select(
        F.col("pos").cast("bigint").alias("pos"), joined("tokens").alias("tokens")
    )


def target_tokens(spark, sf_dir, given=sequences):
    return batches.target_tokens(batches.collate(_short(spark, sf_dir, given)))


# Audit. A file is one source and language; the files of one language failed.
def _audited(spark, sf_dir):
    articles = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat_ws("/", "source", "lang").alias("file"), F.col("source").alias("folder")
    )
    failed = F.endswith("file", F.lit("/de"))
    return audit.file_counts(articles).withColumns(
        {
            "n_articles": F.when(~failed, F.col("n_articles")),
            "error": F.when(failed, "invalid JSON"),
        }
    )


_AUDITED_SQL = (
    "SELECT source || '/' || lang AS file, source AS folder, CASE WHEN lang <> 'de' THEN count(*) END AS n_articles,"
    " CASE WHEN lang = 'de' THEN 'invalid JSON' END AS error FROM documents GROUP BY source, lang"
)


def file_counts(spark, sf_dir):
    return _audited(spark, sf_dir)


def audit_totals(spark, sf_dir):
    return audit.audit_totals(_audited(spark, sf_dir)).withColumn("mean_articles", F.round("mean_articles", 6))


def folder_rollup(spark, sf_dir):
    return audit.folder_rollup(_audited(spark, sf_dir))


def rank_files(spark, sf_dir):
    return audit.rank_files(_audited(spark, sf_dir))


def rank_files_top(spark, sf_dir):
    return audit.rank_files(_audited(spark, sf_dir), k=10)


QUERIES = {
    "truncate_tokens": truncate_tokens,
    "split_corpus": split_corpus,
    "corpus_stats": corpus_stats,
    "split_shares": split_shares,
    "filter_short": filter_short,
    "short_counts": short_counts,
    "pad_min": pad_min_rows,
    "assign_batches": assign_batches,
    "shuffle_rows": shuffle_rows,
    "collate": collate,
    "batch_rows": batch_rows,
    "shift_pairs": shift_pairs,
    "dataset_summary": dataset_summary,
    "preview": preview,
    "target_tokens": target_tokens,
    "file_counts": file_counts,
    "audit_totals": audit_totals,
    "folder_rollup": folder_rollup,
    "rank_files": rank_files,
    "rank_files_top": rank_files_top,
}
# The same with the ids of the default vocabulary, which SQL cannot train.
QUERIES |= {
    f"{query.__name__}_full": functools.partial(query, given=full_sequences)
    for query in (
        truncate_tokens, split_corpus, corpus_stats, split_shares, collate, batch_rows, shift_pairs, dataset_summary,
        preview, target_tokens
    )
}

_TURNS_SQL = f"SELECT conv_id, turn, {word_ids_sql('text')} AS tokens FROM conversations"
_ALL_TURNS_SQL = (
    f"{_TURNS_SQL} UNION ALL SELECT -1, i, ([8, 9]::INT[])[1:i % 3] FROM (SELECT unnest(range(6))::BIGINT AS i)"
)

ORACLES = {
    "truncate_tokens": (
        f"SELECT doc_id, token_count, truncated, array_to_string(tokens, ' ') AS tokens FROM ({_BUILT_SQL})"
    ),
    "split_corpus": f"SELECT doc_id, split FROM ({_BUILT_SQL})",
    "corpus_stats": (
        "SELECT count(*) AS articles, count(*) FILTER (truncated) AS truncated_articles,"
        " round(100.0 * count(*) FILTER (truncated) / count(*), 6)::DOUBLE AS truncated_pct,"
        " round(avg(token_count), 6) AS mean_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens,"
        f" sum(token_count)::BIGINT AS total_tokens FROM ({_BUILT_SQL})"
    ),
    "split_shares": (
        "SELECT split, count(*) AS samples, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct"
        f" FROM ({_BUILT_SQL}) GROUP BY split"
    ),
    "filter_short": (
        f"SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens FROM ({_ALL_TURNS_SQL}) WHERE len(tokens) >= 2"
    ),
    "short_counts": (
        "SELECT count(*) FILTER (len(tokens) >= 2) AS kept, count(*) FILTER (len(tokens) < 2) AS dropped"
        f" FROM ({_ALL_TURNS_SQL})"
    ),
    "pad_min": (
        "SELECT conv_id, turn, array_to_string(CASE WHEN len(tokens) < 64 THEN list_resize(tokens, 64, 0) ELSE tokens END,"
        f" ' ') AS tokens FROM ({_TURNS_SQL})"
    ),
    "assign_batches": (
        "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id,"
        " (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS pos FROM documents"
    ),
    "shuffle_rows": (
        "SELECT doc_id, n // 8 AS batch_id, n % 8 AS pos FROM (SELECT doc_id,"
        " row_number() OVER (ORDER BY md5('7:1:' || doc_id), doc_id) - 1 AS n FROM documents)"
    ),
    "collate": (
        "SELECT batch_id, max(width)::BIGINT AS width, string_agg(array_to_string(tokens, ' '), ';' ORDER BY pos) AS rows"
        f" FROM ({_PADDED_SQL}) GROUP BY batch_id"
    ),
    "batch_rows": f"SELECT batch_id, pos, array_to_string(tokens, ' ') AS tokens FROM ({_PADDED_SQL})",
    "shift_pairs": (
        "SELECT batch_id, pos, array_to_string(tokens[1:len(tokens) - 1], ' ') AS input_ids,"
        f" array_to_string(tokens[2:], ' ') AS target_ids FROM ({_PADDED_SQL})"
    ),
    "dataset_summary": (
        "SELECT split, count(*) AS samples, ceil(count(*) / 8)::BIGINT AS batches"
        f" FROM ({_BUILT_SQL}) WHERE len(tokens) >= 2 GROUP BY split"
    ),
    "preview": (
        "SELECT pos, array_to_string(list_resize(tokens, width, 0)[1:20], ' ') AS tokens FROM (SELECT *,"
        " max(len(tokens)) OVER () AS width FROM (SELECT tokens, row_number() OVER (ORDER BY doc_id) - 1 AS pos"
        f" FROM ({_BUILT_SQL}) WHERE split = 'val' AND len(tokens) >= 2 ORDER BY doc_id LIMIT 8)) WHERE pos < 2"
    ),
    "target_tokens": (
        "SELECT batch_id, (count(*) * (max(width) - 1))::BIGINT AS num_tokens,"
        " (coalesce(sum(len(tokens) - 1), 0))::BIGINT AS real_tokens"
        f" FROM ({_COLLATED_SQL}) GROUP BY batch_id"
    ),
    "file_counts": _AUDITED_SQL,
    "audit_totals": (
        "SELECT sum(n_articles)::BIGINT AS articles, count(*) AS files, max(n_articles) AS max_articles,"
        " min(n_articles) AS min_articles, round(sum(n_articles) / count(*), 6)::DOUBLE AS mean_articles"
        f" FROM ({_AUDITED_SQL})"
    ),
    "folder_rollup": (
        "SELECT folder, sum(n_articles)::BIGINT AS articles, count(*) AS files"
        f" FROM ({_AUDITED_SQL}) WHERE n_articles IS NOT NULL GROUP BY folder"
    ),
    "rank_files": f"SELECT * FROM ({_AUDITED_SQL}) ORDER BY coalesce(n_articles, 0) DESC, file",
    "rank_files_top": f"SELECT * FROM ({_AUDITED_SQL}) ORDER BY coalesce(n_articles, 0) DESC, file LIMIT 10",
}
