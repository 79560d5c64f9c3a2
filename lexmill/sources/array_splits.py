"""JSON arrays of any layout, read in splits: one large file is the work of many tasks.

The text source cuts files at every ``}``, wherever it stands, so Spark may split
a file anywhere. Whether a character lies in a string, and how deep, depends on
all before it; but each split changes both in a way that is known without that:

1. ``_split_states``: every split is read once for its transition: whether it flips
   being inside a string, and how it changes the depth for either beginning.
   Transitions of the splits of a file are combined in order (a running sum over
   one row per split), which gives the state in which each split begins.
2. ``_segments``: every split is read again from that state and cut at the borders
   of the array: its brackets and the commas between its elements. What lies between
   two borders of a split is an element. What a split begins and ends with
   is put together over splits by the number of borders before it.

A file that is no array has no borders and comes out as one value. Elements may be
values of any kind. Compressed files have no splits: read these with
``articles.scan_arrays``, whose rows and errors are the same.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.sources import articles

#: The states of splits are broadcast; a million splits of 128 MB are 128 TB.
MAX_SPLITS = 1_000_000

_ESCAPED = re.compile(rb"\\.", re.S)
_TOKEN = re.compile(rb'\\.|["{}\[\],]', re.S)
_BLANK = r"^[ \t\r\n]*$"
_CUT = b"}"


def _pieces(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The texts between closing braces, in the order of each split."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("lineSep", _CUT.decode())
    return reader.text(path).select(
        F.col("value").cast("binary").alias("value"),
        "_metadata.file_path",
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
    )


def _transition(piece: bytes) -> tuple[int, int, int]:
    """Quotes modulo 2, and the change of depth if the piece begins outside of a string and inside."""
    parts = (_ESCAPED.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    outside, inside = b"".join(parts[::2]), b"".join(parts[1::2])
    return (len(parts) - 1) % 2, *[
        part.count(b"{") + part.count(b"[") - part.count(b"}") - part.count(b"]") for part in (outside, inside)
    ]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """Pieces with ``(file, start, size)`` of their split; a split's pieces follow each other."""
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("file_path", "start", "size", "value")]
        yield from (((file, start, size), value) for file, start, size, value in zip(*columns))


def _split_states(pieces: DataFrame) -> DataFrame:
    """``file_path, start`` of every split with the state in which it begins, and what its file is.

    ``inside, depth``; ``is_array``; ``open_end``, whether the file's last piece was not ended by a brace, for
    its last split; ``sound``, whether the file ends outside of a string with every bracket closed.
    """

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, split = [], None
        for key, value in _by_split(batches):
            if key != split:
                split = key
                rows.append([*key, 0, 0, 0, 0, None])
            row, piece = rows[-1], value + _CUT
            flips, outside, inside = _transition(piece)
            if row[3]:
                outside, inside = inside, outside
            row[3] ^= flips
            row[4] += outside
            row[5] += inside
            row[6] += len(piece)
            if row[7] is None:
                first = value.lstrip(b" \t\r\n")[:1]
                row[7] = first.decode("latin-1") or None
        columns = list(zip(*rows)) or [[]] * 8
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_TRANSITION)

    schema = "file_path string, start long, size long, flips long, outside long, inside long, bytes long, first string"
    splits = pieces.mapInArrow(transitions, schema)
    order = W.partitionBy("file_path").orderBy("start")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file_path")
    begun = splits.withColumns(
        {
            "starts_inside": F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1,
            "is_array": F.coalesce(F.first("first", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == "[", F.lit(False)),
            "is_last": F.col("start") == F.max("start").over(whole),
            # Every piece was taken to end in a brace; the last one of a file need not.
            "open_end": F.sum("bytes").over(whole) > F.col("size"),
        }
    )
    change = F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside"))
    ends_outside = (F.col("starts_inside").cast("long") + F.col("flips")) % 2 == 0
    placed = begun.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    last_depth = F.col("depth") + F.col("change") + F.when(F.col("open_end"), 1).otherwise(0)
    return placed.select(
        "file_path",
        "start",
        F.col("starts_inside").alias("inside"),
        "depth",
        "is_array",
        (F.col("open_end") & F.col("is_last")).alias("open_end"),
        F.max(F.col("is_last") & ends_outside & (last_depth == 0)).over(whole).alias("sound"),
    )


_TRANSITION = ["file_path", "start", "size", "flips", "outside", "inside", "bytes", "first"]
_SEGMENT = "file_path string, start long, part long, borders long, opened string, closed string, text string"


class _Cutter:
    """Cuts the text of a split at the borders of its array."""

    def __init__(self, inside: bool, depth: int, is_array: bool) -> None:
        self.inside, self.depth, self.is_array = inside, depth, is_array
        self.opened, self.text, self.borders = None, [], 0

    def cut(self, piece: bytes) -> Iterator[tuple]:
        """The segments that end in this piece: ``(index, opened, closed, text)``."""
        at = 0
        for token in _TOKEN.finditer(piece):
            char = token.group()
            if char == b'"':
                self.inside = not self.inside
            elif self.inside or len(char) > 1:
                continue
            elif char in b"[{":
                if self.depth == 0 and char == b"[" and self.is_array:
                    yield self._border(piece[at : token.start()], char)
                    at = token.end()
                self.depth += 1
            elif char in b"]}":
                self.depth -= 1
                if self.depth == 0 and self.is_array:
                    yield self._border(piece[at : token.start()], char)
                    at = token.end()
            elif self.depth == 1 and self.is_array:
                yield self._border(piece[at : token.start()], char)
                at = token.end()
        self.text.append(piece[at:])

    def _border(self, rest: bytes, char: bytes) -> tuple:
        found = (self.borders, self.opened, char, b"".join([*self.text, rest]))
        self.opened, self.text, self.borders = char, [], self.borders + 1
        return found

    def rest(self) -> tuple:
        return self.borders, self.opened, None, b"".join(self.text)


def _as_text(values: list) -> pa.Array:
    """Bytes as strings; whether they are valid UTF-8 is asked of each element later."""
    binary = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(binary), binary.buffers()[1], binary.buffers()[2], binary.buffers()[0])


def _segments(pieces: DataFrame, states: dict) -> DataFrame:
    """What lies between the borders of each split; the first and the last part of a split may go on beyond it.

    ``part`` is 0 for what a split begins with, 1 for whole segments, 2 for its end.
    ``borders`` is the number of borders of the split, beside its beginning.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(states)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            arrays = [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
            return pa.RecordBatch.from_arrays([*arrays, *[_as_text(list(c)) for c in columns[4:]]], names=[part.split()[0] for part in _SEGMENT.split(", ")])

        def of_split(split: tuple, values: Iterator[tuple[bytes, bool]]) -> Iterator[list]:
            inside, depth, is_array, open_end = shared.value[split[:2]]
            cutter, head = _Cutter(inside, depth, is_array), None
            for value, is_last in values:
                for index, opened, closed, text in cutter.cut(value if is_last and open_end else value + _CUT):
                    if index == 0:
                        head = [*split[:2], 0, 0, None, closed, text]
                    else:
                        yield [*split[:2], 1, 0, opened, closed, text]
            index, opened, _, text = cutter.rest()
            if head is None:
                yield [*split[:2], 0, 0, None, None, text]
            else:
                head[3] = index
                yield head
                yield [*split[:2], 2, 0, opened, None, text]

        for split, values in _grouped(_by_split(batches)):
            for row in of_split(split, values):
                rows.append(row)
                size += len(row[-1])
                if size > 4 << 20 or len(rows) >= 10_000:
                    yield batch_of()
                    rows, size = [], 0
        yield batch_of()

    return pieces.mapInArrow(segments, _SEGMENT)


def _grouped(pieces: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[tuple, Iterator[tuple[bytes, bool]]]]:
    """Splits with their pieces, each piece with whether it is the split's last."""
    waiting = next(pieces, None)

    def of_one(split: tuple) -> Iterator[tuple[bytes, bool]]:
        nonlocal waiting
        while waiting is not None and waiting[0] == split:
            value, waiting = waiting[1], next(pieces, None)
            yield value, waiting is None or waiting[0] != split

    while waiting is not None:
        split = waiting[0]
        yield split, of_one(split)


def _stitched(segments: DataFrame) -> DataFrame:
    """Whole segments, and those put together from the ends of splits: ``file_path, opened, closed, text``."""
    parts = segments.filter("part <> 1")
    before = W.partitionBy("file_path").orderBy("start", "part").rowsBetween(W.unboundedPreceding, -1)
    # Only the beginning of a split tells its borders, so that they count once, for all behind it.
    placed = parts.withColumn("number", F.coalesce(F.sum("borders").over(before), F.lit(0)))
    joined = placed.groupBy("file_path", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "opened", "closed", "text"))).alias("found")
    )
    first, last = F.element_at("found", 1), F.element_at("found", -1)
    text = F.array_join(F.transform("found", lambda part: part["text"]), "")
    whole = segments.filter("part = 1").select("file_path", "opened", "closed", "text")
    return whole.unionByName(joined.select("file_path", first["opened"].alias("opened"), last["closed"].alias("closed"), text.alias("text")))


def read_values(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The values of all matching files, and one row per file.

    The first is ``file_path, is_array, text, error``: the elements of arrays, or the whole text of
    another file; ``error`` marks what is not exactly one JSON value. The second is
    ``file_path, is_array, error`` of every file that is not empty, for its brackets.
    """
    pieces = _pieces(spark, path, glob)
    found = _split_states(pieces)
    states = found.limit(MAX_SPLITS + 1).collect()
    if len(states) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    begins = {(row["file_path"], row["start"]): (row["inside"], row["depth"], row["is_array"], row["open_end"]) for row in states}
    per_file = {row["file_path"]: (row["is_array"], None if row["sound"] else articles.INVALID_JSON) for row in states}
    files = spark.createDataFrame([(name, *kind) for name, kind in per_file.items()], "file_path string, is_array boolean, error string")
    segments = _stitched(_segments(pieces, begins)).join(F.broadcast(files.select("file_path", "is_array")), "file_path")
    blank = F.col("text").rlike(_BLANK)
    # Beside the array stands nothing; an array without elements holds nothing.
    beside = F.col("is_array") & (F.col("opened").isNull() | (F.col("opened") == "]"))
    nothing = blank & F.col("is_array") & (beside | ((F.col("opened") == "[") & (F.col("closed") == "]")))
    again = (F.col("opened") == "]") & F.col("closed").isNotNull()
    wrong = (beside & ~blank) | again | (F.coalesce(F.col("closed") == "}", F.lit(False)) & F.col("is_array")) | ~articles.is_one_json_value(F.col("text"))
    values = segments.filter(~nothing | F.coalesce(again, F.lit(False)))
    return values.select("file_path", "is_array", "text", F.when(F.coalesce(wrong, F.lit(False)), articles.INVALID_JSON).alias("error")), files


def scan_split_arrays(spark: SparkSession, path: str, mode: str = "lenient", glob: str = "*.json") -> DataFrame:
    """The rows of ``articles.scan_arrays``, with files read in splits. An error is a row of its file without a record."""
    articles.check_mode(mode)
    values, files = read_values(spark, path, glob)
    record = F.try_element_at(articles.records_of(F.concat(F.lit("["), F.col("text"), F.lit("]"))), F.lit(1))
    read = values.withColumn("record", F.when(F.col("is_array") & F.col("error").isNull(), record))
    is_bad = F.col("is_array") & (F.col("record").isNull() | (F.col("record.kind") == "bad"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(is_bad, articles.OTHER_ERROR)
    if mode == "strict":
        incomplete = F.col("is_array") & (~F.col("record.has_text") | (F.col("record.kind") != "object"))
        error = error.when(incomplete | (~F.col("is_array") & ~articles.is_empty_value(F.col("text"))), articles.OTHER_ERROR)
    judged = read.select("file_path", "record", error.alias("error"))
    # "invalid JSON" sorts before "other": it is the error of a file that has both.
    errors = files.select("file_path", "error").union(judged.select("file_path", "error").filter("error is not null"))
    errors = errors.groupBy("file_path").agg(F.min("error").alias("error"))
    base = articles.base_folder(spark, path)
    with_text = judged.filter("error is null and record.kind = 'object' and record.has_text")
    rows = with_text.select("file_path", "record.title", "record.text", F.lit(None).cast("string").alias("error"))
    has_text, has_record = F.col("text").isNotNull(), F.col("is_record")
    marked = rows.withColumn("is_record", F.lit(True)).unionByName(errors.withColumn("is_record", F.lit(False)), allowMissingColumns=True)
    named = marked.withColumn("file", articles.relative_file(base, F.col("file_path")))
    scan = named.select(
        "file",
        articles.folder_of(F.col("file")).alias("folder"),
        "title",
        "text",
        (has_record & has_text).alias("is_article"),
        (has_record & ~has_text).alias("null_text"),
        "error",
    )
    return articles.with_empty_files(scan, path, glob, articles.INVALID_JSON)


def read_split_arrays(spark: SparkSession, path: str, mode: str = "lenient", glob: str = "*.json") -> DataFrame:
    """Articles of a JSON-array tree whose files may have any size and layout."""
    return articles.accepted(scan_split_arrays(spark, path, mode, glob))


def count_split_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """The rows of ``articles.count_array_files``, with arrays counted in splits."""
    values, files = read_values(spark, path, glob)
    count, error = articles.counted_value(F.col("text"))
    judged = values.select(
        "file_path",
        F.when(F.col("is_array"), F.lit(1).cast("bigint")).otherwise(count).alias("n"),
        F.coalesce("error", F.when(~F.col("is_array"), error)).alias("error"),
    )
    every = files.select("file_path", F.when(F.col("is_array"), F.lit(0).cast("bigint")).alias("n"), "error").union(judged)
    counts = every.groupBy("file_path").agg(F.sum("n").alias("n_articles"), F.min("error").alias("error"))
    base = articles.base_folder(spark, path)
    named = counts.withColumn("file", articles.relative_file(base, F.col("file_path"))).select(
        "file",
        articles.folder_of(F.col("file")).alias("folder"),
        F.when(F.col("error").isNull(), F.col("n_articles")).alias("n_articles"),
        "error",
    )
    empty = articles.empty_files(spark, path, glob).withColumn("error", F.lit(articles.INVALID_JSON))
    return named.unionByName(empty, allowMissingColumns=True).filter(F.length(F.regexp_replace("file", "[^/]", "")) == 1)
