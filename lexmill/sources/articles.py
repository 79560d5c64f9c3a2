"""Article files: JSON lines and JSON arrays, with file-level rejection.

A *scan* has one row per record, or one row for a file without records:
``file, folder, title, text, is_article, null_text, error``. ``file`` is
relative to the scanned folder. An error on any row rejects the whole file.

Files are listed before they are read. A scan has one more row per listed file, with the
bytes it should have (``file_bytes``); every other row says how many bytes it stands for
(``n_bytes``). A file that delivers less was lost, broken or denied, and is rejected as
``unreadable`` instead of failing the job; ``with_reasons`` tells denied files from others.
"""

import fnmatch
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.cleaning import is_blank, strip_whitespace
from lexmill.session import materialize

INVALID_JSON = "invalid JSON"
OTHER_ERROR = "other"
NOT_RECOGNISED = "structure not recognised"
UNREADABLE = "unreadable"
NO_PERMISSION = "permission"

# Rejected file names are broadcast up to this number and joined beyond it.
MAX_BROADCAST_FILES = 100_000

_STRICT_JSON = {"allowSingleQuotes": "false"}
_RECORD_END = "\n  }"
_END_MARK = "~end of value~"
_MARKED_RECORD = f"array<struct<title:variant,text:variant,`{_END_MARK}`:boolean>>"
# Readers leave out what they cannot read; the listing shows what is lacking.
_LENIENT_READ = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}
# A byte order mark at the start of a file is read, but is in no line.
_MARK_BYTES = 3
_DENIALS = ("AccessControlException", "AccessDeniedException")
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"


def base_folder(spark: SparkSession, path: str) -> str:
    """The absolute path of a folder as its file system knows it, without scheme and host."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(given).toUri().getPath().rstrip("/")


def relative_file(base: str, file: Column) -> Column:
    """The file below ``base``, a result of ``base_folder``; a file that is not below it is an error.

    File metadata comes as an encoded URI.
    """
    decoded = F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    own = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.when(own == base, F.regexp_extract(own, "[^/]*$", 0)).when(
        F.startswith(own, F.lit(base + "/")), F.substr(own, F.lit(len(base.encode("utf-16-le")) // 2 + 2))
    )
    return F.coalesce(below, F.raise_error(F.concat(F.lit(f"not below {base}: "), file)).cast("string"))


def _listing(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """The files that a scan of the folder would read, their content left alone."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreMissingFiles=True)
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path)


def empty_files(spark: SparkSession, path: str, glob: str | None = None, listing: DataFrame | None = None) -> DataFrame:
    """``file, folder`` of the files of zero bytes, which Spark's readers leave out.

    Spark's list of names has them, its scan has not. Only names that the scan
    lacks are looked at one by one; hidden files do not count, as in a scan.
    """
    listing = _listing(spark, path, glob) if listing is None else listing
    base = base_folder(spark, path)
    names = [(unquote(urlsplit(file).path).removeprefix(base + "/"),) for file in listing.inputFiles()]
    scanned = listing.select(relative_file(base, F.col("_metadata.file_path")).alias("file"))
    lacking = spark.createDataFrame(names, "file string").join(scanned, "file", "left_anti").collect()
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for row in lacking:
        parts = row["file"].split("/")
        hidden = any(part.startswith(".") or part.startswith("_") and "=" not in part for part in parts)
        if not hidden and (glob is None or fnmatch.fnmatchcase(parts[-1], glob)):
            full = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{row['file']}")
            # What was lost since it was listed is lacking, too.
            if system.exists(full) and system.getFileStatus(full).getLen() == 0:
                found.append((row["file"],))
    return spark.createDataFrame(found, "file string").withColumn("folder", folder_of(F.col("file")))


def listed_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, folder, file_bytes`` of every file that a scan of the folder would read, those of zero bytes too.

    Spark lists the folders, many of them on executors, and executors ask for the length
    of each file. The list is stored at once, so files that are lost later stay on it. Spark's
    own list leaves out files of zero bytes.
    """
    found = _listing(spark, path, glob)
    file = relative_file(base_folder(spark, path), F.col("_metadata.file_path"))
    named = found.select(file.alias("file"), F.col("length").alias("file_bytes"))
    listed = named.select("file", folder_of(F.col("file")).alias("folder"), "file_bytes")
    return materialize(listed.unionByName(empty_files(spark, path, glob, found).withColumn("file_bytes", F.lit(0).cast("bigint"))))


def _without_records(files: DataFrame, error: Column) -> DataFrame:
    return files.withColumns({"is_article": F.lit(False), "null_text": F.lit(False), "error": error.cast("string")})


def with_listing(scan: DataFrame, listing: DataFrame, error: str | None) -> DataFrame:
    """A scan with a row for each listed file; one of zero bytes has the given error."""
    rows = _without_records(listing, F.when(F.col("file_bytes") == 0, F.lit(error)))
    return scan.unionByName(rows.withColumn("n_bytes", F.lit(0).cast("bigint")), allowMissingColumns=True)


def with_empty_files(scan: DataFrame, path: str, glob: str | None, error: str | None) -> DataFrame:
    """A scan whose reader fails on what it cannot read, with a row for each file of zero bytes."""
    empty = _without_records(empty_files(scan.sparkSession, path, glob), F.lit(error))
    return scan.unionByName(empty, allowMissingColumns=True)


def folder_of(file: Column) -> Column:
    """The folder part, ``.`` for files at the top."""
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def is_one_json_value(value: Column) -> Column:
    """True if the text is exactly one JSON value, nothing before or after it.

    The parser ignores what follows a value, so the text is put into an array
    with an end mark behind it: the array must hold the value and the mark.
    """
    marked = F.from_json(F.concat(F.lit("["), value, F.lit(f',"{_END_MARK}"]')), "array<string>", _STRICT_JSON)
    alone = (F.size(marked) == 2) & (F.try_element_at(marked, F.lit(2)) == _END_MARK)
    return F.is_valid_utf8(value) & F.coalesce(alone, F.lit(False))


def _opening(value: Column) -> Column:
    return F.left(strip_whitespace(value), F.lit(1))


def jsonl_records(lines: DataFrame, path: str) -> DataFrame:
    """A scan of lines ``(value, file_path)``; a blank line is no article and no error, a text or title that is no string is one.

    A line is parsed once: with an end mark behind it in one array, which also shows whether it is one value.
    Lines that are no objects are parsed only for their error.
    """
    value = F.col("value")
    blank = is_blank(value)
    is_object = _opening(value) == "{"
    end_mark = F.lit(f',{{"{_END_MARK}":true}}]')
    marked = F.from_json(F.concat(F.lit("["), value, end_mark), _MARKED_RECORD, _STRICT_JSON)
    one_value = (F.size("marked") == 2) & F.col("marked")[1][_END_MARK] & F.is_valid_utf8(value)
    record = F.col("marked")[0]
    title, text = record["title"], record["text"]

    def is_text(field: Column) -> Column:
        return F.coalesce(F.schema_of_variant(field), F.lit("VOID")).isin("STRING", "VOID")

    error = (
        F.when(blank, None)
        .when(~is_object, F.when(is_one_json_value(value), OTHER_ERROR).otherwise(INVALID_JSON))
        .when(~F.coalesce(one_value, F.lit(False)), INVALID_JSON)
        .when(~is_text(title) | ~is_text(text), OTHER_ERROR)
    )
    base = base_folder(lines.sparkSession, path)
    return (
        lines.withColumn("file", relative_file(base, F.col("file_path")))
        .withColumn("marked", F.when(is_object, marked))
        .select(
            "file",
            folder_of(F.col("file")).alias("folder"),
            F.coalesce(F.try_variant_get(title, "$", "string"), F.lit("")).alias("title"),
            F.coalesce(F.try_variant_get(text, "$", "string"), F.lit("")).alias("text"),
            (~blank).alias("is_article"),
            (~blank & F.try_variant_get(text, "$", "string").isNull()).alias("null_text"),
            error.alias("error"),
            *(["n_bytes"] if "n_bytes" in lines.columns else []),
        )
    )


def _counted_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with the bytes they stand for: ``value, file_path, n_bytes``.

    Line feeds end what the reader delivers, so its bytes add up to those of the file; carriage
    returns end lines as well and are found afterwards. How many bytes a compressed file holds is not
    known: it stands for all its bytes, and one that breaks off fails the job.
    """
    compressed = F.col("_metadata.file_name").rlike(_COMPRESSED)
    columns = [F.col("value"), F.col("_metadata.file_path").alias("file_path")]
    plain = spark.read.options(**_LENIENT_READ).option("lineSep", "\n").text(path).filter(~compressed)
    packed = spark.read.options(**_LENIENT_READ | {"ignoreCorruptFiles": "false"}).option("lineSep", "\n").text(path).filter(compressed)
    lines = plain.select(*columns, (F.octet_length("value") + 1).cast("bigint").alias("n_bytes")).unionByName(
        packed.select(*columns, F.col("_metadata.file_size").alias("n_bytes"))
    )
    value = F.col("value")
    # Splitting would mend invalid bytes; such a line is an error as it is.
    returns = F.contains(value, F.lit("\r")) & F.is_valid_utf8(value)
    parts = lines.select("file_path", "n_bytes", F.posexplode(F.when(returns, F.split(value, "\r")).otherwise(F.array(value))).alias("part", "value"))
    return parts.select("value", "file_path", F.when(F.col("part") == 0, F.col("n_bytes")).alias("n_bytes"))


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Scan a folder tree of JSON-lines files of any extension, in splits."""
    listing = listed_files(spark, path)
    return with_listing(jsonl_records(_counted_lines(spark, path), path), listing, None)


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    reader = spark.read.options(**_LENIENT_READ).option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select("value", "_metadata.file_path", F.col("_metadata.file_size").alias("n_bytes"))


def check_mode(mode: str) -> None:
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode!r}")


def records_of(value: Column) -> Column:
    """The elements of a JSON array: ``kind`` (object, skipped, bad), ``has_text, title, text``; null for what is no array."""

    def record(item: Column) -> Column:
        text = F.try_variant_get(item, "$.text", "string")
        kind = F.schema_of_variant(item)
        return F.struct(
            F.when(F.startswith(kind, F.lit("OBJECT")), "object")
            .when((kind == "STRING") | F.startswith(kind, F.lit("ARRAY")), "skipped")
            .otherwise("bad")
            .alias("kind"),
            F.coalesce(F.try_variant_get(item, "$.text", "variant").isNotNull(), F.lit(False)).alias("has_text"),
            F.try_variant_get(item, "$.title", "string").alias("title"),
            text.alias("text"),
        )

    # Repeated keys are no valid variant; the parser of structs takes their last value.
    plain = F.from_json(value, "array<struct<title:string,text:string>>", _STRICT_JSON)
    repeated = F.transform(
        plain, lambda item: F.struct(F.lit("object").alias("kind"), item["text"].isNotNull().alias("has_text"), item["title"].alias("title"), item["text"].alias("text"))
    )
    return F.coalesce(F.transform(F.from_json(value, "array<variant>", _STRICT_JSON), record), repeated)


def is_empty_value(value: Column) -> Column:
    """An object without keys, or an empty string."""
    return F.regexp_replace(strip_whitespace(value), r"\s", "").isin("{}", '""')


def scan_arrays(spark: SparkSession, path: str, mode: str = "lenient", glob: str = "*.json") -> DataFrame:
    """Scan the files of a folder tree that match ``glob``, each one JSON array of records.

    Lenient: other JSON values hold no articles; records without ``text``, strings
    and lists among the records are skipped. Strict: all of these make the file an
    error; numbers, truth values and nulls among the records always do. A null
    text is not an article. Of a repeated key the last value counts. A file of
    zero bytes is no JSON.
    """
    check_mode(mode)
    listing, value = listed_files(spark, path, glob), F.col("value")
    unusual = F.col("records").isNull() | F.exists("records", lambda item: item["kind"] == "bad")
    error = F.when(~is_one_json_value(value), INVALID_JSON).when((_opening(value) == "[") & unusual, OTHER_ERROR)
    if mode == "strict":
        incomplete = F.exists("records", lambda item: ~item["has_text"] | (item["kind"] != "object"))
        error = error.when((_opening(value) == "[") & incomplete, OTHER_ERROR).when(
            (_opening(value) != "[") & ~is_empty_value(value), OTHER_ERROR
        )
    with_text = F.filter("records", lambda item: item["has_text"] & (item["kind"] == "object"))
    base = base_folder(spark, path)
    scan = (
        _whole_files(spark, path, glob)
        .withColumn("records", F.when(_opening(value) == "[", records_of(value)))
        .select(relative_file(base, F.col("file_path")).alias("file"), "n_bytes", error.alias("error"), with_text.alias("records"))
        .select("file", "n_bytes", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("records"))).alias("record"))
        .select(
            "file",
            folder_of(F.col("file")).alias("folder"),
            "record.title",
            "record.text",
            F.col("record.text").isNotNull().alias("is_article"),
            (F.col("record").isNotNull() & F.col("record.text").isNull()).alias("null_text"),
            "error",
            "n_bytes",
        )
    )
    return with_listing(scan, listing, INVALID_JSON)


def scan_indented_arrays(
    spark: SparkSession, path: str, mode: str = "lenient", glob: str = "*.json"
) -> DataFrame:
    """Scan JSON arrays of any size that were written with an indent of two.

    The end of a record is then a line of its own. JSON strings hold no raw line
    break, so the text source can split files there and one file is read by many
    tasks. Records must be objects with at least one key. A file that breaks the
    layout or is not closed is an error.
    """
    check_mode(mode)
    listing = listed_files(spark, path, glob)
    reader = spark.read.options(**_LENIENT_READ).option("pathGlobFilter", glob)
    chunks = reader.option("lineSep", _RECORD_END).text(path).select("value", "_metadata.file_path")
    value = F.col("value")
    opens, closes = value.rlike(r"^(\[|,)\n  \{\n"), value.rlike(r"^(\n\]|\[\])\s*$")
    text = F.concat(F.substring(value, F.instr(value, "{"), F.length(value)), F.lit(_RECORD_END))
    error = F.when(~closes & ~(opens & is_one_json_value(text)), INVALID_JSON)
    if mode == "strict":
        error = error.when(opens & ~F.map_contains_key("record", "text"), OTHER_ERROR)
    article = F.try_element_at("record", F.lit("text"))
    scan = (
        chunks.withColumn("file", relative_file(base_folder(spark, path), F.col("file_path")))
        .withColumn("record", F.when(opens, F.from_json(text, "map<string,string>", _STRICT_JSON)))
        .select(
            "file",
            folder_of(F.col("file")).alias("folder"),
            F.try_element_at("record", F.lit("title")).alias("title"),
            article.alias("text"),
            article.isNotNull().alias("is_article"),
            (F.coalesce(F.map_contains_key("record", "text"), F.lit(False)) & article.isNull()).alias("null_text"),
            error.alias("error"),
            closes.alias("closes"),
            (F.octet_length(value) + len(_RECORD_END)).cast("bigint").alias("n_bytes"),
        )
    )
    unclosed = scan.groupBy("file", "folder").agg(F.count_if("closes").alias("ends")).filter("ends <> 1")
    errors = _without_records(unclosed.select("file", "folder"), F.lit(INVALID_JSON))
    return with_listing(scan.drop("closes").unionByName(errors, allowMissingColumns=True), listing, INVALID_JSON)


def accepted(scan: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Articles of files without an error: ``file, folder, title, text``.

    The names of rejected files come from the ledger, if there is one, or from a
    pass of their own. They are broadcast after a check of their number, so texts
    are not shuffled to reject files. A file lost after that pass is lacking without
    a mark; ``n_articles`` of the ledger shows it.
    """
    found = (load_ledger(scan) if ledger is None else ledger).filter("status = 'error'")
    bad = materialize(found.select("file").distinct())
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_FILES else bad
    return scan.filter("is_article").join(bad, "file", "left_anti").select("file", "folder", "title", "text")


def read_jsonl_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a JSON-lines tree; one bad line rejects its file."""
    return accepted(scan_jsonl(spark, path))


def read_article_arrays(
    spark: SparkSession, path: str, mode: str = "lenient", glob: str = "*.json", indented: bool = False
) -> DataFrame:
    """Articles of a JSON-array tree.

    By default a file is one value of one task, with its error beside it.
    ``indented`` reads files of the indented layout in splits, whatever their size.
    """
    if indented:
        return accepted(scan_indented_arrays(spark, path, mode, glob))
    return (
        scan_arrays(spark, path, mode, glob)
        .filter(F.col("error").isNull() & F.col("is_article"))
        .select("file", "folder", "title", "text")
    )


def load_ledger(scan: DataFrame) -> DataFrame:
    """One row per file: ``status``, ``error``, ``n_articles``, ``null_texts``."""
    error = F.max("error")
    if "file_bytes" in scan.columns:
        lacking = F.coalesce(F.sum("n_bytes"), F.lit(0)) + _MARK_BYTES < F.max("file_bytes")
        error = F.when((F.max("file_bytes") > 0) & (lacking | (F.count("*") == 1)), UNREADABLE).otherwise(error)
    ledger = scan.groupBy("file", "folder").agg(
        error.alias("error"),
        F.count_if("is_article").alias("n_articles"),
        F.count_if("null_text").alias("null_texts"),
    )
    failed = F.col("error").isNotNull()
    return ledger.select(
        "file",
        "folder",
        F.when(failed, "error").otherwise("ok").alias("status"),
        "error",
        *[F.when(failed, 0).otherwise(F.col(name)).alias(name) for name in ("n_articles", "null_texts")],
    )


def with_reasons(ledger: DataFrame, path: str) -> DataFrame:
    """A ledger of ``path`` whose unreadable files are told apart: those that may not be read become ``permission``.

    The file system is asked for unreadable files alone, one call for each, from the driver.
    """
    spark = ledger.sparkSession
    hadoop, base = spark._jvm.org.apache.hadoop, base_folder(spark, path)
    given = hadoop.fs.Path(path)
    system = given.getFileSystem(spark._jsc.hadoopConfiguration())
    is_file = system.exists(given) and system.getFileStatus(given).isFile()

    def is_denied(file: str) -> bool:
        try:
            system.access(hadoop.fs.Path(base if is_file else f"{base}/{file}"), hadoop.fs.permission.FsAction.READ)
        except Py4JJavaError as failed:
            return failed.java_exception.getClass().getSimpleName() in _DENIALS
        return False

    unread = ledger.filter(F.col("error") == UNREADABLE).select("file")
    denied = [(row["file"],) for row in unread.toLocalIterator() if is_denied(row["file"])]
    marks = spark.createDataFrame(denied, "file string").withColumn("denied", F.lit(True))
    told = F.when(F.col("denied"), NO_PERMISSION).otherwise(F.col("error"))
    return ledger.join(marks, "file", "left").withColumn("error", told).drop("denied")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Articles loaded, files loaded and files rejected."""
    return ledger.agg(
        F.coalesce(F.sum("n_articles"), F.lit(0)).alias("articles"),
        F.count_if(F.col("status") == "ok").alias("files"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def require_nonempty(df: DataFrame) -> DataFrame:
    """The same DataFrame, or an error if no article was loaded."""
    if df.isEmpty():
        raise ValueError("no text was loaded")
    return df


def counted_value(value: Column) -> tuple[Column, Column]:
    """Articles in a JSON value, and its error: an array counts its elements, an object those of its first array."""
    entries = F.map_entries(F.from_json(value, "map<string,variant>", _STRICT_JSON))
    arrays = F.filter(entries, lambda entry: F.startswith(F.schema_of_variant(entry["value"]), F.lit("ARRAY")))
    sizes = F.transform(arrays, lambda entry: F.size(F.try_variant_get(entry["value"], "$", "array<variant>")))
    first = F.try_element_at(sizes, F.lit(1))
    valid = is_one_json_value(value)
    count = F.when(valid & (_opening(value) == "["), F.json_array_length(value)).when(
        valid & (_opening(value) == "{"), first
    )
    error = (
        F.when(~valid, INVALID_JSON)
        .when(_opening(value) == "[", None)
        .when(_opening(value) != "{", OTHER_ERROR)
        .when(first.isNull(), NOT_RECOGNISED)
    )
    return count, error


def count_array_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Articles per matching file exactly one folder below ``path``; a file of zero bytes is no JSON, an unreadable one has that error.

    An array counts its elements, an object those of its first array-valued
    key; anything else is an error: ``file, folder, n_articles, error``.
    """
    listing = listed_files(spark, path, glob)
    count, error = counted_value(F.col("value"))
    counts = (
        _whole_files(spark, path, glob)
        .withColumn("file", relative_file(base_folder(spark, path), F.col("file_path")))
        .select(
            "file",
            folder_of(F.col("file")).alias("folder"),
            count.cast("bigint").alias("n_articles"),
            error.alias("error"),
        )
    )
    lacking = F.when(F.col("file_bytes") == 0, INVALID_JSON).otherwise(UNREADABLE)
    found = listing.join(counts.withColumn("was_read", F.lit(True)), ["file", "folder"], "left")
    every = found.select("file", "folder", "n_articles", F.when(F.col("was_read"), F.col("error")).otherwise(lacking).alias("error"))
    return every.filter(F.length(F.regexp_replace("file", "[^/]", "")) == 1)


def write_cleaned(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write articles below one sub-folder per source folder.

    Every task writes its own files, so a large folder needs no shuffle and no
    two source files collide.
    """
    df.write.partitionBy("folder").format(file_format).save(path)
