"""MediaWiki XML dumps, plain or bz2, read in parallel splits."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE_START, _PAGE_END = "<page>", "</page>"
_PAGE = (
    "title string, ns int, id bigint, redirect struct<_title:string>,"
    " revision struct<id:bigint, text:struct<_VALUE:string>>, _malformed string"
)


def scan_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: ``page_id, revision_id, ns, title, text, redirect, malformed``.

    The text source splits the dump at the end of each page, also inside bz2, and
    every chunk is parsed by itself; the ``xml`` source would read a bz2 dump in a
    single task. ``malformed`` has the page that could not be parsed, whose other
    columns are null. Of a page with several revisions, as full-history dumps
    have them, the last one counts.
    """
    chunks = spark.read.option("lineSep", _PAGE_END).text(path)
    start = F.instr("value", _PAGE_START)
    # The last chunk of a dump is its footer and starts no page.
    page = F.from_xml(
        F.concat(F.substring(F.col("value"), start, F.length("value")), F.lit(_PAGE_END)),
        _PAGE,
        {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_malformed"},
    )
    pages = chunks.filter(start > 0).select(page.alias("page"))
    good = F.col("page._malformed").isNull()
    return pages.select(
        F.when(good, F.col("page.id")).alias("page_id"),
        F.when(good, F.col("page.revision.id")).alias("revision_id"),
        F.when(good, F.col("page.ns")).alias("ns"),
        F.when(good, F.col("page.title")).alias("title"),
        F.when(good, F.coalesce("page.revision.text._VALUE", F.lit(""))).alias("text"),
        (good & F.col("page.redirect").isNotNull()).alias("redirect"),
        F.col("page._malformed").alias("malformed"),
    )


def read_wiki_dump(spark: SparkSession, path: str, namespaces: Iterable[int] | None = (0,)) -> DataFrame:
    """One row per article: ``page_id, revision_id, ns, title, text``.

    Redirects and malformed pages are left out (``dump_ledger`` counts them);
    ``namespaces=None`` keeps every namespace.
    """
    pages = scan_wiki_dump(spark, path).filter(F.col("malformed").isNull() & ~F.col("redirect"))
    if namespaces is not None:
        pages = pages.filter(F.col("ns").isin(*namespaces))
    return pages.drop("redirect", "malformed")


def dump_ledger(scan: DataFrame) -> DataFrame:
    """Pages by what becomes of them: ``status`` (article, redirect, malformed), ``ns``, ``pages``."""
    status = F.when(F.col("malformed").isNotNull(), "malformed").when(F.col("redirect"), "redirect").otherwise("article")
    return scan.groupBy(status.alias("status"), "ns").agg(F.count(F.lit(1)).alias("pages"))
