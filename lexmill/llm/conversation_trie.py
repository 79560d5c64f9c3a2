"""The trie of conversation prefixes: which conversations share how many of their first turns, and what sharing saves.

A node is a distinct sequence of the first ``d`` turns (role, text) of rebuilt
conversations; the root has none. Its name is its smallest member and its depth.

1. ``rebuilt_paths``: the turns of five conversations, one of which lends the
   others its head, meet in one task, sorted; they stream through it, and each
   turn extends a 128-bit digest of its prefix (BLAKE2b over the digest before
   it and both fields with their lengths). From here on texts stay behind.
2. ``possibly_shared``: a count-min table of the digests, ``ROWS`` rows of
   ``width`` cells. Spark adds up the cells; what is sent to the tasks is one bit
   per cell, whether it counts more than one (``ROWS * width / 8`` bytes, 2 MB by default). A prefix
   with a cell of one has estimate one, which proves that no other conversation has it.
3. Nodes with such a proof are emitted where they are: one member, no shuffle.
   Only the others are grouped, exactly, by digest; a crowded table costs
   shuffling, never a wrong row.
4. A node belongs to its smallest member, so the nodes of a conversation are the
   end of its path, and the nodes below ``v`` are all that its members own, but
   for those above ``v`` of its own smallest member. So sums over subtrees are sums over members:
   no node meets its descendants.

Groups with very many members (the root; a common first turn) are only counted
and added up, which tasks do first. The hash over the members that end at a node
must read them in order: they are range-partitioned by node and id, joined into
long strings there, and only the strings of one node pass through one hash.

Cases: a null role or text is empty; a null turn comes first; equal turn numbers
are ordered by role and text, and repeated rows are turns of their own. Rows
without a conversation id are left out. A conversation's turns are streamed through one task, whatever
their number; very long texts are digested one by one. An empty table gives no
rows. Only the named columns are read, under names of ours. Ids are whole numbers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.texts import own_columns, stored

#: Conversation ``c`` takes its head of fewer than MAX_HEAD turns from ``c - c % FAMILY``.
FAMILY = 5
MAX_HEAD = 9
#: The count-min table: rows, and cells of a row (a power of two, at most 2**32).
ROWS = 4
WIDTH = 1 << 22
_BITMAP = 32_768  # bits of one bitmap of Spark's bitmap functions

_ROOT = bytes(16)
_OUT_ROWS = 20_000
_PATH = "conv_id long, depth long, hi long, lo long, parent_hi long, parent_lo long, n_bytes long, is_end boolean"


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MAX_HEAD


def extended(digest: bytes, role: bytes, text: bytes) -> bytes:
    """The digest of a prefix with one more turn."""
    found = hashlib.blake2b(digest, digest_size=16)
    found.update(len(role).to_bytes(8, "little"))
    found.update(role)
    found.update(text)
    return found.digest()


class _Paths:
    """The path of the conversation being read; a row is written once it is known whether it is the last."""

    def __init__(self) -> None:
        self.conv_id, self.waiting, self.rows = None, None, []

    def start(self, conv_id: int) -> None:
        self.finish()
        self.conv_id = conv_id
        self.waiting = (0, _ROOT, None, 0)

    def add(self, role: bytes, text: bytes) -> None:
        depth, digest = self.waiting[:2]
        self._write(False)
        self.waiting = (depth + 1, extended(digest, role, text), digest, len(text))

    def finish(self) -> None:
        if self.waiting is not None:
            self._write(True)
            self.waiting = None

    def _write(self, is_end: bool) -> None:
        self.rows.append((self.conv_id, *self.waiting, is_end))

    def take(self) -> pa.RecordBatch:
        conv_ids, depths, digests, parents, sizes, ends = zip(*self.rows)
        self.rows = []
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        above = np.frombuffer(b"".join(parent or _ROOT for parent in parents), np.int64).reshape(-1, 2)
        no_parent = np.array([parent is None for parent in parents])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(conv_ids, pa.int64()),
                pa.array(depths, pa.int64()),
                *[pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)],
                *[pa.array(np.ascontiguousarray(above[:, i]), mask=no_parent) for i in (0, 1)],
                pa.array(sizes, pa.int64()),
                pa.array(ends, pa.bool_()),
            ],
            names=["conv_id", "depth", "hi", "lo", "parent_hi", "parent_lo", "n_bytes", "is_end"],
        )


def rebuilt_paths(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each prefix of each rebuilt conversation: ``conv_id, depth``, its digest, that of the prefix before, the bytes of
    its last text, and whether the conversation ends there."""
    as_bytes = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")
    turns = own_columns(df, conv_id=F.col(conv_id).cast("long"), turn=turn, role=as_bytes(role), text=as_bytes(text)).where("conv_id is not null")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    placed = turns.select(family.alias("family"), "conv_id", "turn", head_turns(F.col("conv_id")).alias("head"), "role", "text")
    # The lender is the first of its family in the order of ids for which it is read first.
    order = ["family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    sorted_turns = placed.repartition("family").sortWithinPartitions(*order).select("family", "conv_id", "head", "role", "text")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, family, lent, position = _Paths(), None, [], 0
        for batch in batches:
            for row_family, row_id, head, role, text in zip(*[column.to_pylist() for column in batch.columns]):
                if row_family != family:
                    family, lent = row_family, []
                if row_id != found.conv_id:
                    found.start(row_id)
                    position = 0
                    for turn in lent[:head]:
                        found.add(*turn)
                if row_id == family:
                    if len(lent) < MAX_HEAD:
                        lent.append((role, text))
                    found.add(role, text)
                elif position >= head:
                    found.add(role, text)
                position += 1
                if len(found.rows) >= _OUT_ROWS:
                    yield found.take()
        found.finish()
        if found.rows:
            yield found.take()

    return sorted_turns.mapInArrow(paths, _PATH)


def _cells(width: int) -> list[str]:
    """SQL of the cell of a digest in each row of the table; the digest's own bits are the hashes."""
    bits = ["hi", "lo", "shiftrightunsigned(hi, 32)", "shiftrightunsigned(lo, 32)"]
    return [f"{row * width}L + ({bits[row]} & {width - 1}L)" for row in range(ROWS)]


def shared_cells(paths: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The count-min table as one bit per cell: whether it counts more than one prefix of a conversation.

    Cells are added up in Spark; at most ``ROWS * width / 32768`` bitmaps of 4 kB come back.
    """
    cells = paths.select(F.explode(F.array(*[F.expr(cell) for cell in _cells(width)])).alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select((F.col("cell") + 1).alias("cell"))
    bitmaps = crowded.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    found = np.zeros(max(ROWS * width, _BITMAP) // 8, np.uint8)
    for row in bitmaps.collect():
        at = (row["bucket"] - 1) * _BITMAP // 8
        found[at : at + _BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


def possibly_shared(paths: DataFrame, width: int = WIDTH) -> DataFrame:
    """The paths with ``shared`` and ``parent_shared``: false where the table proves one member."""
    bits = paths.sparkSession.sparkContext.broadcast(shared_cells(paths, width))
    mask = np.uint64(width - 1)

    def estimate_above_one(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shared = np.ones(len(hi), bool)
        parts = [hi, lo, hi >> np.uint64(32), lo >> np.uint64(32)]
        for row in range(ROWS):
            cell = np.uint64(row * width) + (parts[row] & mask)
            shared &= (bits.value[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return shared

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = {name: batch.column(name).fill_null(0).to_numpy().view(np.uint64) for name in ("hi", "lo", "parent_hi", "parent_lo")}
            shared = estimate_above_one(halves["hi"], halves["lo"])
            above = estimate_above_one(halves["parent_hi"], halves["parent_lo"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared), pa.array(above)], names=[*batch.schema.names, "shared", "parent_shared"])

    return paths.mapInArrow(screened, _PATH + ", shared boolean, parent_shared boolean")


def ends_hashes(members: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256``: the hash of the ids, in order and joined by commas, that end at a node."""
    order = ["hi", "lo", "conv_id"]
    placed = members.where("is_end").select(order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, ids = [column.to_numpy() for column in batch.columns]
            at = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at]), pa.array(ids[at]), pa.array(texts, pa.string())], names=[*order, "ids"])

    parts = placed.mapInArrow(joined, "hi long, lo long, conv_id long, ids string")
    parts = parts.repartition("hi", "lo").sortWithinPartitions(*order)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running, done = None, None, []

        def written() -> pa.RecordBatch:
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_pylist(rows, pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())]))

        for batch in batches:
            for hi, lo, ids in zip(*[batch.column(name).to_pylist() for name in ("hi", "lo", "ids")]):
                if (hi, lo) == node:
                    running.update(b",")
                else:
                    if node is not None:
                        done.append({"hi": node[0], "lo": node[1], "ends_sha256": running.hexdigest()})
                    node, running = (hi, lo), hashlib.sha256()
                running.update(ids.encode())
            if done:
                yield written()
        if node is not None:
            done.append({"hi": node[0], "lo": node[1], "ends_sha256": running.hexdigest()})
            yield written()

    return parts.mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, proven``."""
    paths = stored(rebuilt_paths(df, conv_id, turn, role, text), "conversation-paths")
    screened = possibly_shared(paths, width)
    alone, members = screened.where("not shared"), screened.where("shared")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    empty_hash = F.lit(hashlib.sha256(b"").hexdigest())

    keys = ["hi", "lo", "depth", "parent_hi", "parent_lo", "n_bytes"]
    nodes = members.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = stored(nodes, "shared-nodes")
    # Children of a shared node: shared ones, and the first proven node of a path.
    first_alone = alone.where("parent_shared and depth > 0").select("parent_hi", "parent_lo")
    below = nodes.where("depth > 0").select("parent_hi", "parent_lo").union(first_alone)
    children = below.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    above = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    nodes = nodes.join(children, ["hi", "lo"], "left").select(
        *keys,
        "conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        saved.alias("saved"),
        F.coalesce(F.sum(saved).over(above), zero).alias("saved_above"),
    )
    nodes = stored(nodes, "counted-nodes")

    # What each conversation owns: the savings of its nodes, and its leaf if it has one.
    owned = (
        nodes.select("conv_id", "saved", F.when(F.col("n_children") == 0, one).otherwise(zero).alias("leaves"))
        .union(alone.where("is_end").select("conv_id", zero, one))
        .groupBy("conv_id")
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    sums = members.select("hi", "lo", "conv_id").join(owned, "conv_id", "left").groupBy("hi", "lo").agg(F.sum("saved").alias("saved_all"), F.sum("leaves").alias("leaves"))
    shared = (
        nodes.join(sums, ["hi", "lo"])
        .join(ends_hashes(members), ["hi", "lo"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_hi",
            "parent_lo",
            "n_convs",
            "n_children",
            F.coalesce("leaves", zero).alias("n_leaves"),
            (F.coalesce("saved_all", zero) - F.col("saved_above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", empty_hash).alias("ends_sha256"),
            F.lit(False).alias("proven"),
        )
    )
    own_hash = F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty_hash)
    tails = alone.select(
        "conv_id",
        "depth",
        *[F.when(F.col("parent_shared"), F.col(name)).alias(name) for name in ("parent_hi", "parent_lo")],
        one.alias("n_convs"),
        F.when(F.col("is_end"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        own_hash.alias("ends_sha256"),
        F.lit(True).alias("proven"),
    )
    # Where the node above is proven too, it is the same conversation's and needs no look-up.
    names = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("named"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "proven"]
    parent = F.when(F.col("depth") > 0, F.coalesce("named", "conv_id")).alias("parent_conv_id")
    looked_up = shared.union(tails.where("parent_hi is not null")).join(names, ["parent_hi", "parent_lo"], "left").withColumn("parent_conv_id", parent)
    inner = tails.where("parent_hi is null").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return looked_up.select(columns).union(inner.select(columns))
