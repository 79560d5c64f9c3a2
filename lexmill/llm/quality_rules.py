"""Quality rules per host: failures of documents are summed by domain, shrunk, and the host's verdict returns to its documents.

1. Each text is measured by itself (``measures``): words, characters in words,
   symbols, repeated lines, words in repeated five-word windows. Rules turn the
   measures into failures (``RULES``).
2. Failures of every rule are summed per host. Hosts differ in size, so a rate is
   shrunk towards the mean of all hosts by an empirical beta prior, whose
   strength comes from the spread of the hosts' rates beyond what their sizes
   explain (moments of the beta-binomial, weighted by documents).
3. A host whose shrunk rate of some rule exceeds ``max_rate`` is rejected with all
   its documents; the base rule rejects single documents besides.

Measures are written once and read for the sums and for the join, so texts are
read once. Sums are combined within tasks; the join sends only documents' numbers,
and a host with very many documents is split by Spark's skew join.

Cases: a null text has no words and fails the base rule, as an empty or blank one
does. A null host belongs to no host: only the document's own measures count.
Long texts form a slice of their own, in memory linear in the text. Rows are
judged one by one, so equal rows and equal or null ids stay as they are. Without
spread between hosts, with one host, or without any failure, the prior is
the common rate itself. An empty table gives no rows. Columns of the input other
than the named ones are not read, so their names cannot clash.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.texts import SPACE, exact_codes, own_columns, slices, stored, text_bytes, within, word_bounds

#: Fixed values of the base rule and its measures.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Further rules count for hosts only. A rule is the measures' condition under which a document fails it.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUPLICATE_LINES_PER_WORD = 0.05
WORD_CHARS = (2.0, 14.0)
RULES = {
    "base": f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"n_symbols > {MAX_SYMBOLS_PER_WORD}D * n_words",
    "lines": f"n_dup_lines > {MAX_DUPLICATE_LINES_PER_WORD}D * n_words",
    "word_length": f"n_words > 0 and word_chars not between {WORD_CHARS[0]}D * n_words and {WORD_CHARS[1]}D * n_words",
}
#: A host with more than this share of failing documents, after shrinking, is rejected.
MAX_RATE = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_IS_SYMBOL = np.isin(np.arange(256), [ord(char) for char in SYMBOLS])
_STARTS_CHAR = np.array([byte & 0xC0 != 0x80 for byte in range(256)])
_NOT_NEWLINE = np.arange(256) != ord("\n")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between an offset and the next."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each distinct pair; numbers below 2**31 make keys without collisions."""
    return np.unique(left << 32 | right, return_inverse=True)[1]


def repeated_words(codes: np.ndarray, texts: np.ndarray, inside: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``length`` words that its text has at least twice.

    ``codes`` number the words, ``texts`` the text of each; ``inside`` says where a
    window ends in its text. Windows get exact numbers by pairing those of shorter ones.
    """
    covered = np.zeros(len(codes), bool)
    n = len(codes) - length + 1
    if n <= 0:
        return covered
    windows = codes
    for extra in range(1, length):
        windows = _paired(windows[: len(codes) - extra], codes[extra:])
    at = np.flatnonzero(inside[:n])
    _, back, counts = np.unique(windows[at] << 32 | texts[at], return_inverse=True, return_counts=True)
    found = at[counts[back] > 1]
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + length, -1)
    return np.cumsum(steps[:-1]) > 0


def text_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; null is empty."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    if not len(data):
        return {name: np.zeros(n, np.int64) for name in MEASURES}
    in_word = ~SPACE[data]
    starts, ends, firsts = word_bounds(in_word, offsets)
    texts = np.repeat(np.arange(n), np.diff(firsts))
    codes, _ = exact_codes(data, starts, ends)
    repeated = repeated_words(codes, texts, within(firsts, WINDOW))

    # Lines without a word count neither as a repetition nor as what is repeated.
    line_starts, line_ends, line_firsts = word_bounds(_NOT_NEWLINE[data], offsets)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_codes, _ = exact_codes(data, line_starts, line_ends)
    line_texts = np.repeat(np.arange(n), np.diff(line_firsts))[with_word]
    distinct = np.unique(line_texts << 32 | line_codes[with_word]) >> 32
    lines = np.bincount(line_texts, minlength=n) - np.bincount(distinct, minlength=n)
    return {
        "n_words": np.diff(firsts),
        "word_chars": _per_text(in_word & _STARTS_CHAR[data], offsets),
        "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": lines,
        "n_repeat_words": _per_text(repeated, firsts),
    }


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host`` and the measures of every row's whole text."""
    given = own_columns(df, doc_id=key, host=F.col(host).cast("string"), text=text)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = text_measures(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("host"), *[pa.array(found[name], pa.int64()) for name in MEASURES]],
                    names=["doc_id", "host", *MEASURES],
                )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(measured, f"doc_id {kind}, host string, " + ", ".join(f"{name} long" for name in MEASURES))


def failures(measured: DataFrame) -> DataFrame:
    """The measures with one column ``failed_<rule>`` (0 or 1) for each rule."""
    return measured.withColumns({f"failed_{rule}": F.expr(f"cast({condition} as long)") for rule, condition in RULES.items()})


def host_counts(failed: DataFrame) -> DataFrame:
    """Documents and failures of every rule per host; rows of no host are left out."""
    sums = [F.sum(f"failed_{rule}").alias(f"failed_{rule}") for rule in RULES]
    return failed.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *sums)


def _prior(rule: str, k: Column, n: Column, squares: Column) -> Column:
    """The mean rate and the correlation within hosts, ``1 / (strength + 1)`` of the beta prior, of one rule."""
    total = F.sum(f"failed_{rule}")
    mean = total / n
    noise = mean * (1 - mean)
    # sum of n_i (r_i - mean)^2, written without another pass over the hosts
    spread = F.sum(F.col(f"failed_{rule}") * F.col(f"failed_{rule}") / F.col("n_docs")) - total * mean
    beyond = noise * (n - squares / n - (k - 1))
    within_hosts = F.when(beyond > 0, F.least(F.greatest((spread - noise * (k - 1)) / beyond, F.lit(0.0)), F.lit(1.0)))
    return F.struct(mean.alias("mean"), F.coalesce(within_hosts, F.lit(0.0)).alias("rho")).alias(f"prior_{rule}")


def priors(hosts: DataFrame) -> DataFrame:
    """One row: for each rule the prior that the hosts themselves give (columns ``prior_<rule>`` of ``mean, rho``)."""
    n = F.sum("n_docs")
    squares = F.sum(F.col("n_docs").cast("double") * F.col("n_docs"))
    return hosts.agg(*[_prior(rule, F.count("*"), n, squares) for rule in RULES])


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``host, n_docs, rate_<rule>..., rejected``: shrunk rates and the verdict of every host.

    The rate is ``(failures + strength * mean) / (n_docs + strength)``, both sides
    divided by ``strength + 1``, so that no spread at all (an infinite strength) is the mean.
    """
    found = priors(hosts).select(F.struct("*")).scalar()
    rates = {}
    for rule in RULES:
        mean, rho = found[f"prior_{rule}"]["mean"], found[f"prior_{rule}"]["rho"]
        rates[f"rate_{rule}"] = (F.col(f"failed_{rule}") * rho + (1 - rho) * mean) / (F.col("n_docs") * rho + (1 - rho))
    rated = hosts.select("host", "n_docs", *[rate.alias(name) for name, rate in rates.items()])
    return rated.withColumn("rejected", F.greatest(*rates) > max_rate)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, failures and the verdict of every document: ``base_failed``, ``host_rejected``, ``kept`` and the host's rates."""
    failed = failures(stored(measures(df, key, text, host), "quality-measures"))
    hosts = stored(host_verdicts(stored(host_counts(failed), "host-counts"), max_rate), "host-verdicts")
    joined = failed.join(hosts.withColumnRenamed("n_docs", "host_docs"), "host", "left")
    base_failed = F.col("failed_base") == 1
    host_rejected = F.coalesce("rejected", F.lit(False))
    return joined.select(
        "doc_id",
        "host",
        *MEASURES,
        base_failed.alias("base_failed"),
        host_rejected.alias("host_rejected"),
        (~base_failed & ~host_rejected).alias("kept"),
        *[(F.col(f"failed_{rule}") == 1).alias(f"failed_{rule}") for rule in RULES],
        *[f"rate_{rule}" for rule in RULES],
    )
