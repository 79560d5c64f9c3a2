"""All queries and, where SQL can express them, their SQL twins."""

from lexmill.functions.cleaning import clean_text
from lexmill.functions.tokens import words_of
from lexmill.operators.corpus import corpus_stats, truncate_tokens
from lexmill.plans import corpus_queries, file_queries, log_queries, markup_queries, model_queries, text_queries, token_queries
from lexmill.plans.inputs import marked_up_documents


def flagship(spark, sf_dir):
    cleaned = marked_up_documents(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))
    return corpus_stats(truncate_tokens(cleaned.select(words_of("text").alias("tokens"))))


_MODULES = (text_queries, token_queries, corpus_queries, log_queries, file_queries, model_queries, markup_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
