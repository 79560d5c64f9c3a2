"""How far the sources of a language differ in their words: every two sources, and the words that tell a source.

Chunk factorization. Texts are cut at white space; no term crosses a chunk.

1. Tasks count the chunks of each document and add them up per language and
   source: occurrences, number of documents, and the smallest and largest of
   them (``chunk_counts``). Spark adds the tasks' counts.
2. Every distinct chunk of all texts is cut into terms once (``chunk_terms``).
3. The terms are joined back to the counts: occurrences add up exactly; so would
   documents, were it not for a document that has a term in several chunks.
   Three documents are enough to keep a term. A chunk of three documents decides
   for its terms. A chunk of one or two is described by its two extremes in full,
   so where the sums leave a term open, its distinct documents are counted from
   those (``kept_terms``). Nothing is estimated, and no document is sent along.
4. ``divergence`` compares the counts. A source lacks most terms of a language;
   all terms it lacks have the same probability there. So the sum over all kept
   terms is one over the terms of each source by itself, from a histogram of its
   probabilities, and a correction over the terms that both have.

Occurrences are ``long``; probabilities are computed in decimals of 38 digits and
fit into ``long``, and so does each of the sums (at most the square of the sum of
both sources' probabilities); they are combined in decimals again.

Cases: null text, language and source are ''. A text without terms, or empty,
still makes its source occur. Every row is a document of its own, also with an
equal or null id; ids are not read. A very long text forms a slice of its own;
a chunk may be as long as a text. Equal values rank by the item's UTF-8 bytes.
A language without kept terms has pairs of value 0. An empty table gives no
rows. Only the named columns are read, under names of ours.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.texts import SPACE, exact_codes, own_columns, slices, stored, text_bytes, word_bounds

#: What a term is, and the scale of probabilities.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
#: A term is kept with this many documents; more could not be told from the extremes of a chunk's documents.
MIN_DOCUMENTS = 3
TOP_TERMS = 200

_ROWS_OF_A_TASK = 1 << 40


def _as_strings(runs: pa.LargeBinaryArray) -> pa.Array:
    """The same bytes as strings; Spark does not promise valid UTF-8, so they are not validated."""
    return pa.LargeStringArray.from_buffers(len(runs), runs.buffers()[1], runs.buffers()[2], offset=runs.offset).cast(pa.string())


def _counted(part: pa.RecordBatch, first_row: int) -> pa.RecordBatch | None:
    """The chunks of a slice: occurrences, documents and their extremes per language, source and chunk."""
    data, offsets = text_bytes(part.column("text"))
    if not len(data):
        return None
    starts, ends, firsts = word_bounds(~SPACE[data], offsets)
    if not len(starts):
        return None
    codes, chunks = exact_codes(data, starts, ends)
    documents, in_document = np.unique(np.repeat(np.arange(part.num_rows), np.diff(firsts)) << 32 | codes, return_counts=True)
    row, code = documents >> 32, documents & 0xFFFFFFFF
    group = np.zeros(part.num_rows, np.int64)
    for name in ("lang", "source"):
        labels = part.column(name).dictionary_encode().indices.to_numpy().astype(np.int64)
        group = np.unique(group << 32 | labels, return_inverse=True)[1]
    keys = group[row] << 32 | code
    order = np.argsort(keys, kind="stable")  # rows of a key stay in order: its first and last are the extremes
    keys, row = keys[order], row[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    last = np.append(at[1:], len(keys)) - 1
    lead = pa.array(row[at])
    return pa.RecordBatch.from_arrays(
        [
            part.column("lang").take(lead),
            part.column("source").take(lead),
            _as_strings(chunks.take(pa.array(keys[at] & 0xFFFFFFFF))),
            pa.array(np.add.reduceat(in_document[order], at), pa.int64()),
            pa.array(last - at + 1, pa.int64()),
            pa.array(first_row + row[at], pa.int64()),
            pa.array(first_row + row[last], pa.int64()),
        ],
        names=["lang", "source", "chunk", "n", "n_docs", "low_doc", "high_doc"],
    )


def chunk_counts(df: DataFrame) -> DataFrame:
    """``lang, source, chunk``, occurrences ``n``, documents ``n_docs`` and the smallest and largest document.

    A document's number is that of its row in its task; only equality counts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() * _ROWS_OF_A_TASK
        for batch in batches:
            for part in slices(batch, "text"):
                found = _counted(part, row)
                row += part.num_rows
                if found is not None:
                    yield found

    rows = df.mapInArrow(counted, "lang string, source string, chunk string, n long, n_docs long, low_doc long, high_doc long")
    return rows.groupBy("lang", "source", "chunk").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.min("low_doc").alias("low_doc"), F.max("high_doc").alias("high_doc")
    )


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``chunk, term``: every distinct chunk is cut once; a term it holds twice has two rows."""
    found = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return chunks.select("chunk").distinct().select("chunk", F.explode(found).alias("term"))


def kept_terms(counts: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, term`` of the terms in at least three documents of the language.

    ``counts`` has for each language, source and term the sum of its chunks'
    documents (``most``) and the largest of them (``least``). Sources have no document in
    common, so both bounds add up over sources; they are equal for most terms.
    """
    bounds = counts.groupBy("lang", "term").agg(F.sum("least").alias("least"), F.sum("most").alias("most"))
    bounds = stored(bounds.where(F.col("most") >= MIN_DOCUMENTS), "term-bounds")
    open_terms = bounds.where(F.col("least") < MIN_DOCUMENTS).select("lang", "term")
    open_chunks = stored(terms.join(open_terms.select("term").distinct(), "term", "left_semi").select("chunk", "term"), "open-chunks")
    # No chunk of an open term has three documents: its extremes are all there are.
    documents = (
        chunks.where(F.col("n_docs") < MIN_DOCUMENTS)
        .join(open_chunks, "chunk")
        .select("lang", "term", F.explode(F.array("low_doc", "high_doc")).alias("doc"))
        .distinct()
        .groupBy("lang", "term")
        .agg(F.count("*").alias("docs"))
    )
    found = documents.where(F.col("docs") >= MIN_DOCUMENTS).join(open_terms, ["lang", "term"], "left_semi")
    return bounds.where(F.col("least") >= MIN_DOCUMENTS).select("lang", "term").union(found.select("lang", "term"))


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n``: occurrences of the kept terms, by chunk factorization. Stored."""
    label = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    chunks = stored(chunk_counts(own_columns(df, text=text, lang=label(lang), source=label(source))), "chunk-counts")
    terms = stored(chunk_terms(chunks), "chunk-terms")
    counts = (
        chunks.select("lang", "source", "chunk", "n", "n_docs")
        .join(terms, "chunk")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("most"), F.max("n_docs").alias("least"))
    )
    counts = stored(counts, "term-counts")
    kept = kept_terms(counts, chunks, terms)
    return stored(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")


def probability(count: str, total: str, size: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + size))`` of three columns, exact for any long counts; null where both are 0."""
    wide = "cast({} as decimal(20,0))".format
    return F.expr(f"1 + (({wide(count)} + 1) * {SCALE}BD) div nullif({wide(total)} + {wide(size)}, 0)")


def difference(p: str, q: str) -> str:
    """``floor((p - q)^2 / q)`` of two probabilities, as SQL."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def groups_of(df: DataFrame, counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, total, size, own, p0``: every source that occurs; ``own`` of the language's ``size`` kept terms occur in it,
    ``total`` times, and ``p0`` is the probability of each of the others."""
    label = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    occurring = own_columns(df, lang=label(lang), source=label(source)).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    sizes = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    found = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    filled = found.select("lang", "source", *[F.coalesce(name, zero).alias(name) for name in ("total", "own", "size")], zero.alias("none"))
    return filled.withColumn("p0", probability("none", "total", "size")).drop("none")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the sum over all kept terms for every two different sources of a language.

    ``f(p, q)`` is summed over the terms that the first has as if the second had
    none, the same for the second, and over the terms that neither has; for terms
    of both, what was added is taken back and the right value added. Every joined
    row serves both directions.
    """
    one, other = groups.alias("a"), groups.alias("b")
    pairs = one.join(other, F.expr("a.lang = b.lang and a.source < b.source")).select(
        F.col("a.lang").alias("lang"),
        F.col("a.source").alias("one"),
        F.col("b.source").alias("two"),
        F.col("a.size").alias("size"),
        *[F.col(f"{side}.{name}").alias(f"{name}_{side}") for side in "ab" for name in ("own", "p0")],
    )
    histogram = stored(cells.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "probability-counts")
    # f(p, other's p0) and f(other's p0, p), summed over the terms that a source has
    alone = (
        histogram.alias("h")
        .join(groups.alias("g"), F.expr("h.lang = g.lang and h.source <> g.source and g.p0 is not null"))
        .groupBy("h.lang", F.col("h.source").alias("has"), F.col("g.source").alias("lacks"))
        .agg(
            F.sum(F.expr(f"m * ({difference('h.p', 'g.p0')})")).alias("has_first"),
            F.sum(F.expr(f"m * ({difference('g.p0', 'h.p')})")).alias("lacks_first"),
        )
    )
    kinds = {"pq": ("p", "q"), "pq0": ("p", "q0"), "p0q": ("p0", "q"), "p0q0": ("p0", "q0")}
    names = {"p": "a.p", "p0": "a.p0", "q": "b.p", "q0": "b.p0"}
    sums = []
    for kind, (left, right) in kinds.items():
        sums.append(F.sum(F.expr(difference(names[left], names[right]))).alias(f"f_{kind}"))
        sums.append(F.sum(F.expr(difference(names[right], names[left]))).alias(f"r_{kind}"))
    both = (
        cells.alias("a")
        .join(cells.alias("b"), F.expr("a.lang = b.lang and a.term = b.term and a.source < b.source"))
        .groupBy("a.lang", F.col("a.source").alias("one"), F.col("b.source").alias("two"))
        .agg(F.count("*").alias("common"), *sums)
    )
    first = alone.select("lang", F.col("has").alias("one"), F.col("lacks").alias("two"), F.col("has_first").alias("f_one"), F.col("lacks_first").alias("r_one"))
    second = alone.select("lang", F.col("lacks").alias("one"), F.col("has").alias("two"), F.col("lacks_first").alias("f_two"), F.col("has_first").alias("r_two"))
    keys = ["lang", "one", "two"]
    joined = pairs.join(both, keys, "left").join(first, keys, "left").join(second, keys, "left")
    wide = lambda text: f"cast(coalesce({text}, 0) as decimal(38,0))"

    def total(side: str, p0: str, q0: str) -> Column:
        neither = f"{wide('size - own_a - own_b')} * {wide(difference(p0, q0))}"
        shared = f"{wide(side + '_pq')} + {wide(side + '_p0q0')} - {wide(side + '_pq0')} - {wide(side + '_p0q')}"
        return F.expr(f"cast({neither} + {wide(side + '_one')} + {wide(side + '_two')} + {shared} as bigint)")

    both_ways = F.array(
        F.struct(F.col("one").alias("source"), F.col("two").alias("item"), total("f", "p0_a", "p0_b").alias("value")),
        F.struct(F.col("two").alias("source"), F.col("one").alias("item"), total("r", "p0_b", "p0_a").alias("value")),
    )
    return joined.select("lang", F.explode(both_ways).alias("found")).select("lang", "found.*")


def telling_terms(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, item, value``: terms more frequent in a source than in its language."""
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = terms.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    whole = terms.join(totals, "lang").select("lang", "term", probability("n", "total", "size").alias("q"))
    found = cells.join(whole, ["lang", "term"]).where("p > q")
    return found.select("lang", "source", F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has all other sources, part ``term`` the ``top_terms`` terms."""
    counts = term_counts(df, text, lang, source)
    groups = stored(groups_of(df, counts, lang, source), "source-groups")
    cells = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", probability("n", "total", "size").alias("p"), "p0")
    cells = stored(cells, "term-probabilities")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(cells, groups).withColumn("rank", F.row_number().over(order))
    terms = telling_terms(cells, counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(terms.withColumn("part", F.lit("term")).select(columns))
