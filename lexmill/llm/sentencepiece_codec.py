"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The texts of a batch are cut into marked words: before each space, which is
written as the mark U+2581, and wherever else no piece can reach across. The
distinct ones are sorted, which lays them out as a trie
in depth-first order: a word's forward states are kept up to the prefix that it
shares with the next word, and only the rest is searched anew.

A forward state at a prefix is, for a unigram model, the best score and the
last piece of a path that reaches it. For a BPE model the scores rank merges
instead of paths, and the state is the last piece of the prefix's encoding:
exactly one piece that ends at a prefix forms a valid pair with the last piece
of what precedes it, and a sequence all of whose adjacent pairs are valid is
the encoding. Both searches run over the same trie.

Null texts give null ids; an empty text gives no ids. Characters that no piece
has become their UTF-8 bytes if the model has byte pieces, else the unknown
piece. Decoding returns the text, but for U+2581 in it, which comes back as a
space, and for characters that were unknown.
"""

from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm.texts import list_array, slices, text_bytes, word_hashes

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Bytes of text that are searched together.
TEXT_BYTES = 4 << 20
#: Pieces that a model may have; they are sent to every task.
MAX_PIECES = 1 << 20
#: Encoded words that a task keeps.
MAX_KEPT = 300_000
MAX_PAIRS = 2_000_000


class Model(NamedTuple):
    """What encoding needs of a model file."""

    kind: int
    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    bytes_at: list[int]
    unknown: int
    dummy_prefix: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def load_model(path: str) -> Model:
    """Read a model file. Only models that leave the text as it is are taken: others change it before they encode."""
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    n = processor.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces are more than the {MAX_PIECES} that may be sent to tasks")
    message = dict(_fields(processor.serialized_model_proto()))
    trainer, normalizer = dict(_fields(message[2])), dict(_fields(message[3]))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models without normalisation and with escaped, kept white space are supported")
    pieces = [processor.id_to_piece(i) for i in range(n)]
    odd = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i) for i in range(n)]
    of_byte = {p: i for i, p in enumerate(pieces) if processor.is_byte(i)}
    bytes_at = [of_byte[f"<0x{b:02X}>"] for b in range(256)] if len(of_byte) == 256 else []
    return Model(kind, pieces, [processor.get_score(i) for i in range(n)], [not x for x in odd], bytes_at, processor.unk_id(), bool(normalizer.get(3, 1)))


class Encoder:
    """Encodes marked words. ``kept`` numbers the words met before, ``first`` has where their ids begin in ``flat``."""

    def __init__(self, model: Model):
        self.model = model
        self.id_of = {p: i for i, p in enumerate(model.pieces) if model.plain[i]}
        self.trie: dict = {}
        for piece, i in self.id_of.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        # Texts are cut between characters that no piece has side by side: no merge and no path crosses such a place.
        self.apart = np.ones((256, 256), bool)
        self.apart[:, 0x80:0xC0] = False
        for piece in self.id_of:
            raw = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            self.apart[raw[:-1], raw[1:]] = False
        self.lowest = min((model.scores[i] for i in self.id_of.values()), default=0.0) - 10
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.flat, self.first = array("i"), array("q", [0])

    def outside(self, c: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.model.bytes_at[b] for b in c.encode()] if self.model.bytes_at else [self.model.unknown]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best adjacent pair, the leftmost of equals, as long as there is one."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.id_of.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.model.scores[piece] > best):
                    best, at = self.model.scores[piece], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: int, piece: int) -> bool:
        """Whether BPE keeps the pair; -1 on the left is the word's start."""
        text = self.model.pieces[piece]
        if left < 0:
            return len(self.merged(text)) == 1
        before = self.model.pieces[left]
        return self.merged(before + text) == [before, text]

    def add(self, words: Iterable[str]) -> None:
        """Encode words that are not kept yet, in depth-first order of their trie."""
        by_score, lowest = self.model.kind == UNIGRAM, self.lowest
        scores, trie, pairs, flat, first = self.model.scores, self.trie, self.pairs, self.flat, self.first
        if len(pairs) > MAX_PAIRS:
            pairs.clear()
        before = ""
        # For each prefix length: best score, last piece, length before it, and the vocabulary's nodes that are open there.
        score, last, back, open_at = [0.0], [-1], [0], [[(0, trie)]]
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], back[shared + 1 :], open_at[shared + 1 :]
            for at in range(shared, len(word)):
                c = word[at]
                nodes, best, piece_best, from_best = [], None, -1, at
                for start, node in open_at[at]:
                    node = node.get(c)
                    if node is None:
                        continue
                    nodes.append((start, node))
                    piece = node.get("")
                    if piece is None:
                        continue
                    if by_score:
                        total = score[start] + scores[piece]
                        if best is None or total > best:
                            best, piece_best, from_best = total, piece, start
                    elif best is None:
                        key = ((last[start] + 1) << 20) + piece
                        kept = pairs.get(key)
                        if kept is None:
                            kept = pairs[key] = self.follows(last[start], piece)
                        if kept:
                            best, piece_best, from_best = 0.0, piece, start
                if best is None or by_score and best < score[at] + lowest:
                    best, piece_best, from_best = score[at] + lowest, -1, at  # the character alone, which is no piece
                score.append(best)
                last.append(piece_best)
                back.append(from_best)
                nodes.append((at + 1, trie))
                open_at.append(nodes)
            ids, at = [], len(word)
            while at:
                piece = last[at]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += self.outside(word[at - 1])[::-1]
                at = back[at]
            ids.reverse()
            flat.extend(ids)
            self.kept[word] = len(first) - 1
            first.append(len(flat))
            before = word

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and each text's offset in them."""
        if len(self.kept) > MAX_KEPT:
            self.forget()
        data, offsets = text_bytes(self.marked(column))
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.apart[data[:-1], data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data))
        _, some, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        whole = data.tobytes()
        distinct = [whole[a:b].decode().replace(" ", MARK) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        self.add({w for w in distinct if w not in self.kept})
        index = np.fromiter(map(self.kept.__getitem__, distinct), np.int64, len(distinct))[which]
        first = np.array(self.first, np.int64)
        begin, n = first[index], first[index + 1] - first[index]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        ids = np.array(self.flat, np.int32)[np.repeat(begin - (after - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]

    def marked(self, column: pa.Array) -> pa.Array:
        """The texts with spaces as marks, one before each text if the model wants it."""
        column = pc.replace_substring(column.cast(pa.large_string()), MARK, " ")
        if not self.model.dummy_prefix:
            return column
        empty, mark = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        return pc.if_else(pc.equal(column, empty), column, pc.binary_join_element_wise(empty, column, mark))


_encoders: dict[int, Encoder] = {}


def _encoder(model: Model) -> Encoder:
    """One encoder for each model in a worker process, so that later tasks find its words."""
    key = hash((model.kind, len(model.pieces), tuple(model.pieces[-50:]), tuple(model.scores[-50:])))
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of ids; byte pieces are joined first."""
    out, run = [], bytearray()
    byte_of = {i: b for b, i in enumerate(model.bytes_at)}
    for i in ids:
        if i in byte_of:
            run.append(byte_of[i])
            continue
        if run:
            out.append(run.decode(errors="replace"))
            run = bytearray()
        if i == model.unknown:
            out.append(" ⁇ ")
        elif model.plain[i]:
            out.append(model.pieces[i])
    out.append(run.decode(errors="replace"))
    text = "".join(out).replace(MARK, " ")
    return text.removeprefix(" ") if model.dummy_prefix else text


class Decoder:
    """Decodes flat ids of many texts at once: the pieces' bytes are gathered by numpy."""

    def __init__(self, model: Model):
        self.model = model
        byte_of = {i: b for b, i in enumerate(model.bytes_at)}
        raw = []
        for i, piece in enumerate(model.pieces):
            if i in byte_of:
                raw.append(bytes([byte_of[i]]))
            elif i == model.unknown:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(piece.replace(MARK, " ").encode() if model.plain[i] else b"")
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and each text's offset in them; the mark before the first word is still there."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.data[np.repeat(self.first[ids] - (ends - n), n) + np.arange(total)]
        return data, np.concatenate([[0], ends])[offsets]


def with_fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The frame's schema with these columns added or replaced."""
    return T.StructType([f for f in df.schema.fields if f.name not in kinds] + [T.StructField(k, v) for k, v in kinds.items()])


def encode(df: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` with the piece ids of ``text``; narrow, nothing is shuffled."""
    schema = with_fields(df, **{ids: T.ArrayType(T.IntegerType())})
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                flat, offsets = encoder.encode(part.column(text))
                made = list_array(flat, offsets, pa.int32())
                null = part.column(text).is_null()
                if null.true_count:
                    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays([made if n == ids else part.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text`` with the text of the piece ids; null ids give null."""
    schema = with_fields(df, **{text: T.StringType()})
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        drop = shared.value.dummy_prefix
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = decoded(part.column(ids), decoder, drop)
                yield pa.RecordBatch.from_arrays([texts if n == text else part.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def decoded(ids: pa.ListArray, decoder: Decoder, drop: bool) -> pa.Array:
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array(ids.value_lengths().fill_null(0))
    data, offsets = decoder.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
    whole = data.tobytes()
    null = ids.is_null().to_pylist()
    return pa.array([None if z else whole[a:b].decode(errors="replace")[int(drop and whole[a : a + 1] == b" ") :] for z, a, b in zip(null, offsets[:-1], offsets[1:], strict=True)], pa.string())


def encode_and_check(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``ids``, ``n_ids``, and ``exact``: whether decoding gives the text again, which is done in the same pass. Null texts: null, 0, null."""
    schema = with_fields(df, ids=T.ArrayType(T.IntegerType()), n_ids=T.LongType(), exact=T.BooleanType())
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, drop = _encoder(shared.value), Decoder(shared.value), shared.value.dummy_prefix
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                flat, offsets = encoder.encode(part.column(text))
                null = part.column(text).is_null()
                made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()), mask=null)
                same = pc.equal(decoded(made, decoder, drop), part.column(text).cast(pa.string()))
                own = {"ids": made, "n_ids": pa.array(np.diff(offsets), pa.int64()), "exact": same}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else part.column(n) for n in names], names)

    return df.mapInArrow(run, schema)
