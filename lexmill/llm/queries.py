"""The registered queries of this subpackage and, where SQL can express one, its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import conversation_trie, decontamination, embedding_dedup, html_extraction, language_id, minhash_dedup, oracles, quality, quality_rules, sentencepiece_codec, source_divergence, substring_dedup, toxicity, url_filter
from lexmill.llm.sampling import held_out
from lexmill.llm.texts import own_columns, table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The rules by which urls are judged first.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, how many, and whether decoding them gives the text again."""
    documents = own_columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    model = sentencepiece_codec.load_model(SENTENCEPIECE_MODEL)
    return sentencepiece_codec.encode_and_check(documents, model).select("doc_id", "ids", "n_ids", "exact")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    labelled = documents.where(~held_out("doc_id")).select("doc_id", "text", "lang")
    model = language_id.fit(labelled, key="doc_id", text="text", lang="lang")
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return language_id.predict(rows, model)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items."""
    documents = own_columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    items = own_columns(table(spark, sf_dir, "benchmark"), item_id="item_id", text="text")
    return decontamination.matches(documents, items)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document by its 4-word shingles."""
    documents = own_columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return minhash_dedup.near_duplicates(documents, size=4, similarity=0.8)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = own_columns(table(spark, sf_dir, "pages"), page_id="page_id", url="url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.col("purity"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by both views, and whether it is kept."""
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = documents.select("doc_id", "text", "source", "lang", "n_chars")
    return quality.score(rows, model).select("doc_id", "score", "content_odds", "metadata_odds", "kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = own_columns(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "toxic")
    index = toxicity.fit(documents, labels)
    return toxicity.score(documents.select("doc_id", held_out("doc_id").alias("held_out"), "text"), index)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document repeat an earlier one's passage, and the digest of the others."""
    documents = own_columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return substring_dedup.digest(documents)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the component of every embedding."""
    embeddings = own_columns(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding")
    return embedding_dedup.linked(embeddings, cosine=0.9)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every two sources of a language differ in their words, and the words that tell each source."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("proven")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document, and whether its own rule and its source's shrunk failure rates keep it."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    rates = [F.round(f"rate_{rule}", 9).alias(f"rate_{rule}") for rule in quality_rules.RULES]
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "host_rejected", "kept", *rates)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = oracles.ORACLES
