"""Queries over pages and marked-up documents: tags, references and the share of letters."""

from pyspark.sql import functions as F

from lexmill.functions.cleaning import strip_nested_templates
from lexmill.functions.markup import letter_share, named_references, strip_refs, strip_tags
from lexmill.operators.corpus import keep_prose
from lexmill.sources.tables import read_table

# References around the given texts: closed in itself, with a template inside, nested, over lines, and one without an end.
_BEFORE = '<ref name="a"/>'
_INSIDE = "<ref>{{cite|a=<ref>b</ref>}}\nline</ref><REF group=x >y</Ref >"
_AFTER = "</ref> <ref>open {{t}}"


def strip_tags_query(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", "page_id", "html").select("page_id", strip_tags("html").alias("text"))


def strip_refs_query(spark, sf_dir):
    """References removed, and templates after them."""
    marked = F.concat(F.lit(_BEFORE), "text", F.lit(_INSIDE), F.col("source"), F.lit(_AFTER))
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return documents.select("doc_id", strip_nested_templates(strip_refs(marked)).alias("text"))


def keep_prose_query(spark, sf_dir):
    """Documents and raw pages that are letters for the most part, with their share of letters."""
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    pages = read_table(spark, sf_dir, "pages", "page_id", "html").toDF("id", "text")
    both = documents.withColumn("origin", F.lit("documents")).unionByName(pages.withColumn("origin", F.lit("pages")))
    return keep_prose(both, 0.75).select("origin", "id", F.round(letter_share("text"), 9).alias("share"))


QUERIES = {"strip_tags": strip_tags_query, "strip_refs": strip_refs_query, "keep_prose": keep_prose_query}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _references_sql(text: str) -> str:
    """References decoded in SQL: every part after an ampersand may begin with one."""
    table = ", ".join(f"{_quoted(name[1:])}: {_quoted(value)}" for name, value in named_references().items())
    name = r"regexp_extract(part, '^(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z0-9]+;)', 1)"
    digits = f"regexp_extract({name}, '^#[xX]?([0-9a-fA-F]+)', 1)"
    number = f"CASE WHEN lower({name}[2]) = 'x' THEN ('0x' || {digits})::BIGINT ELSE {digits}::BIGINT END"
    found = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1] = '#' THEN chr(({number})::INT) ELSE names[{name}] END"
    decoded = f"coalesce({found} || substr(part, length({name}) + 1), '&' || part)"
    return (
        f"SELECT page_id, parts[1] || array_to_string(list_transform(parts[2:], lambda part: {decoded}), '') AS text"
        f" FROM (SELECT page_id, string_split({text}, '&') AS parts FROM pages), (SELECT MAP {{{table}}} AS names)"
    )


_SHOWN_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', ' ', 'g'),"
    r" '(?is)<script\b[^<>]*>.*?(</script\s*>|\z)', ' ', 'g'), '(?is)<style\b[^<>]*>.*?(</style\s*>|\z)', ' ', 'g'),"
    r" '</?[A-Za-z!?][^<>]*>', ' ', 'g')"
)
_DENSE = r"regexp_replace(text, '[\s\p{Z}\x0B]', '', 'g')"

ORACLES = {
    "strip_tags": _references_sql(_SHOWN_SQL),
    "strip_refs": "SELECT doc_id, text || source || '</ref> <ref>open ' AS text FROM documents",
    "keep_prose": (
        "SELECT * FROM (SELECT origin, id, round(length(regexp_replace(dense, '[^\\p{L}\\p{M}]', '', 'g')) / length(dense), 9) AS share"
        f" FROM (SELECT origin, id, {_DENSE} AS dense FROM (SELECT 'documents' AS origin, doc_id AS id, text FROM documents"
        " UNION ALL SELECT 'pages', page_id, html FROM pages))) WHERE share >= 0.75"
    ),
}
