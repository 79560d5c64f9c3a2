import random
import zlib

import compare
import pyarrow as pa
import pytest
from sql_twin import sql_rows

from lexmill.llm import conversation_trie
from lexmill.llm.oracles import ORACLES

SCHEMA = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
KINDS = "conv_id long, turn long, role string, text string, depth long, hi long, family string, shared string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, -1, -2, "f", "s") for row in rows], KINDS)


def conversations(seed, n=60):
    """Few different turns, so that many prefixes are shared; ids beyond and below zero."""
    rng = random.Random(seed)
    rows = []
    for conv_id in range(-20, n - 20):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((conv_id, turn, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "ünï 漢"])))
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (3, None, "user", "first"), (3, None, None, "first"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    return rows


def expected(rows):
    return sql_rows(ORACLES["op12_conversation_trie"], "conversations", rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sql(spark, seed):
    rows = conversations(seed)
    assert compare.spark_bag(conversation_trie.prefix_trie(frame(spark, rows)).drop("proven")) == expected(rows)


@pytest.mark.parametrize("width", [1, 1 << 10, 1 << 16])
def test_a_crowded_table_changes_no_row(spark, width):
    rows = conversations(7)
    trie = conversation_trie.prefix_trie(frame(spark, rows), width=width)
    assert compare.spark_bag(trie.drop("proven")) == expected(rows)
    proven = trie.where("proven")
    assert proven.where("n_convs <> 1").isEmpty()
    assert proven.isEmpty() == (width == 1)


def test_few_shared_prefixes_shuffle(spark):
    """With room in the table, nearly every single prefix is proven to be one."""
    rows = [(c, t, "user", f"{c} {t}" if t else "hello") for c in range(0, 2000, 5) for t in range(4)]
    trie = conversation_trie.prefix_trie(frame(spark, rows))
    assert trie.where("not proven").count() == 2 and trie.where("proven").count() == 1200
    first = trie.where("depth = 1").first()
    assert (first["n_convs"], first["n_children"], first["n_leaves"], first["saved_tokens"]) == (400, 400, 400, 399 * 5)


def test_digest_keeps_fields_apart():
    extended = conversation_trie.extended
    assert extended(bytes(16), b"ab", b"c") != extended(bytes(16), b"a", b"bc")


def test_head_turns_are_crc32(spark):
    ids = [0, 7, -12, 10**15]
    made = spark.createDataFrame([(i,) for i in ids], "c long")
    assert [row[0] for row in made.select(conversation_trie.head_turns(made["c"])).collect()] == [zlib.crc32(str(i).encode()) % 9 for i in ids]


def test_many_equal_conversations_hash_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 5 * 3000, 5)]
    assert compare.spark_bag(conversation_trie.prefix_trie(frame(spark, rows)).drop("proven")) == expected(rows)


def test_one_conversation_and_none(spark):
    for rows in ([(1, 0, "user", "a")], [(1, 0, "user", "a"), (0, 5, "x", "y")], [(4, i, "user", "t" * 100_000) for i in range(12)]):
        assert compare.spark_bag(conversation_trie.prefix_trie(frame(spark, rows)).drop("proven")) == expected(rows)
    assert conversation_trie.prefix_trie(frame(spark, rows).limit(0)).count() == 0
