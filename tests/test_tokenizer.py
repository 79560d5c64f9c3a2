"""Training, encoding and decoding against the public tokenizers package."""

import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library
from tokenizers import decoders, models, normalizers, pre_tokenizers, trainers

from lexmill.functions import joins, tokens
from lexmill.operators import bpe, encoding
from lexmill.sources import tokenizer_store

SF_DIR = "/root/testdata/sf0.001"
TRICKY = [
    "[PAD]x€ [UNK] abc[SEP]",
    "",
    "žluťoučký 한국어 ΑΣ İstanbul",
    "a" * 200 + " " * 7 + "zz  \n\n x" + "ab" * 90,
    "it's we'll 12ab ½² \t\t",
    "the the the",
]


def library_tokenizer():
    library = Library(models.BPE(unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.decoder = decoders.ByteLevel()
    library.normalizer = normalizers.Sequence(
        [normalizers.NFD(), normalizers.Lowercase(), normalizers.StripAccents()]
    )
    return library


def train_library(texts, vocab_size, min_frequency=2):
    library = library_tokenizer()
    trainer = trainers.BpeTrainer(
        vocab_size=vocab_size, special_tokens=tokens.SPECIAL_TOKENS, min_frequency=min_frequency, show_progress=False
    )
    library.train_from_iterator(texts, trainer)
    return library


def model_of(library):
    model = json.loads(library.to_str())["model"]
    return sorted(model["vocab"], key=model["vocab"].get), [tuple(pair) for pair in model["merges"]]


def model_of_ours(tokenizer):
    vocab = [row["token"] for row in tokenizer.vocab.orderBy("id").collect()]
    merges = tokenizer.merges.orderBy("rank").collect()
    return vocab, [(vocab[row["left_id"]], vocab[row["right_id"]]) for row in merges]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    return [row["text"] for row in rows]


@pytest.fixture(scope="module")
def trained(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return bpe.train_bpe(documents, 800)


@pytest.fixture(scope="module")
def library(texts):
    return train_library(texts, 800)


def test_normalisation_of_every_character(spark):
    normalizer = library_tokenizer().normalizer
    # The two Unicode tables differ in age; both know what Unicode 8 assigned.
    old = unicodedata.ucd_3_2_0
    chars = [
        chr(point)
        for point in range(1, 0x110000)
        if unicodedata.category(chr(point)) != "Cs" and old.category(chr(point)) != "Cn"
    ]
    rows = spark.createDataFrame([(i, f"A{char}b") for i, char in enumerate(chars)], "i int, text string")
    got = [row[0] for row in rows.orderBy("i").select(tokens.normalize_text("text")).collect()]
    expected = [normalizer.normalize_str(f"A{char}b") for char in chars]
    changed = [hex(ord(char)) for char, ours, theirs in zip(chars, got, expected) if ours != theirs]
    assert len(changed) < 10, changed


def test_words(spark):
    reference = library_tokenizer()
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "i int, text string").orderBy("i")
    got = rows.select(F.transform(tokens.words_of("text"), tokens.byte_symbols)).collect()
    for text, row in zip(TRICKY, got):
        normal = reference.normalizer.normalize_str(text)
        assert row[0] == [word for word, _ in reference.pre_tokenizer.pre_tokenize_str(normal)]


def test_byte_symbols(spark):
    assert set(tokens.byte_alphabet()) == set(pre_tokenizers.ByteLevel.alphabet())
    broken = spark.range(1).select(tokens.text_of_symbols(F.lit("Ã©â")).alias("text"))
    assert broken.collect()[0]["text"] == "é�"


def test_training_equals_the_library(trained, library):
    assert model_of_ours(trained) == model_of(library)


@pytest.mark.parametrize(
    "limits", [{"frequent_pairs": 16, "digest_rows": 60}, {"frequent_pairs": 2, "digest_rows": 3}]
)
def test_round_limits_do_not_change_the_result(spark, limits):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aab", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(6)]
    texts.append("aaaa aaaaaaa aaaaaaaaaaaaaaaaaa ababab abababab bababa")
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    assert model_of_ours(bpe.train_bpe(df, 60, **limits)) == model_of(train_library(texts, 60))


def test_very_long_words_are_measured_before_they_are_fetched(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_DIGEST_SYMBOLS", 500)
    texts = ["ab" * 150 + " " + "abc" * 70, "abcabc ab ab cab " * 5]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    assert model_of_ours(bpe.train_bpe(df, 30)) == model_of(train_library(texts, 30))


def test_min_frequency_ends_training(spark):
    texts = ["abc abc abd xyz"]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    assert model_of_ours(bpe.train_bpe(df, 500, min_frequency=2)) == model_of(train_library(texts, 500, 2))


def test_encode_and_decode_equal_the_library(spark, texts, trained, library):
    everything = texts + TRICKY
    df = spark.createDataFrame(list(enumerate(everything)), "i int, text string")
    rows = encoding.decode(encoding.encode(df, trained), trained.vocab).orderBy("i").collect()
    for text, row in zip(everything, rows):
        ids = library.encode(text).ids
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids)


def test_a_clipped_sequence_decodes_with_replacement_characters(spark, trained, library):
    df = spark.createDataFrame([("ßßß",)], "text string")
    clipped = encoding.encode(df, trained).select(F.slice("ids", 1, 1).alias("ids"))
    row = encoding.decode(clipped, trained.vocab).collect()[0]
    assert row["decoded"] == library.decode(row["ids"])


def test_null_text_has_no_ids(spark, trained):
    df = spark.createDataFrame([(1, None), (2, "a b")], "i int, text string")
    rows = encoding.encode(df, trained).orderBy("i").collect()
    assert rows[0]["ids"] is None and len(rows[1]["ids"]) > 0


def test_listing_stats_and_round_trip(spark, trained, library):
    df = spark.createDataFrame([(1, "Bonjour le monde!"), (2, "Comment ça va"), (3, "")], "i int, text string")
    encoded = encoding.encode(df, trained)
    listed = encoding.explode_tokens(encoded.filter("i = 1").select("i", "ids"), trained.vocab).orderBy("pos").collect()
    expected = library.encode("Bonjour le monde!")
    assert [(row["pos"], row["token"], row["id"]) for row in listed] == list(
        zip(range(1, 100), expected.tokens, expected.ids)
    )
    checked = encoding.roundtrip_ok(encoding.decode(encoded, trained.vocab)).orderBy("i").collect()
    assert [row["roundtrip_ok"] for row in checked] == [True, False, True]
    stats = encoding.token_stats(encoded, trained.vocab).orderBy("i").collect()
    assert [row["token_count"] for row in stats] == [len(library.encode(row["text"]).ids) for row in stats]
    assert stats[0]["vocab_size"] == 800 and stats[2]["chars_per_token"] is None


def random_merges(rng, repeats):
    """Merges over spelled symbols; two ways to spell a token share its id."""
    spelled, merges = {"a": 0, "b": 1, "c": 2}, []
    while len(merges) < 12:
        left, right = rng.choice(list(spelled)), rng.choice(list(spelled))
        pair, known = (spelled[left], spelled[right]), left + right in spelled
        if all(pair != other[:2] for other in merges) and (repeats or not known):
            merges.append((*pair, spelled.setdefault(left + right, len(spelled))))
    return merges


def joined(words, merges, ascending):
    lengths = np.array([len(word) for word in words])
    ids, lengths = joins.join_words(
        np.array([i for word in words for i in word], np.int32), lengths, joins.join_table(merges), ascending
    )
    return [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]


def replaced(word, left, right, joint, once=False):
    at = 0
    while at + 1 < len(word):
        if word[at : at + 2] == [left, right]:
            word = word[:at] + [joint] + word[at + 2 :]
            if once:
                break
        at += 1
    return word


def random_words(rng):
    return [rng.choices(range(3), k=rng.choice([0, 1, 2, 5, 40])) for _ in range(12)]


def test_joining_one_pair_at_a_time():
    rng = random.Random(1)
    for _ in range(150):
        merges, words = random_merges(rng, repeats=True), random_words(rng)
        expected = []
        for word in words:
            while True:
                pairs = list(zip(word, word[1:]))
                found = [merge for merge in merges if merge[:2] in pairs]
                if not found:
                    break
                word = replaced(word, *found[0], once=True)
            expected.append(word)
        assert joined(words, merges, ascending=False) == expected


def test_joining_pair_after_pair():
    rng = random.Random(2)
    for _ in range(150):
        merges, words = random_merges(rng, repeats=False), random_words(rng)
        expected = []
        for word in words:
            for merge in merges:
                word = replaced(word, *merge)
            expected.append(word)
        assert joined(words, merges, ascending=True) == expected


def test_symbols_survive_as_text():
    ids = np.array([0, 262, 32_000, 55_039, 55_040, 70_000], np.int32)
    words = joins.words_of_symbols(ids.copy(), np.array([1, 0, 5]))
    back, lengths = joins.symbols_of(words)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [1, 0, 5]
    assert [joins.symbol_id(joins.symbol(int(i))) for i in ids] == ids.tolist()


def test_tokenizer_files(spark, trained, library, tmp_path):
    tokenizer_store.write_tokenizer(trained, f"{tmp_path}/store")
    assert model_of_ours(tokenizer_store.read_tokenizer(spark, f"{tmp_path}/store")) == model_of(library)
    with pytest.raises(FileNotFoundError):
        tokenizer_store.read_tokenizer(spark, f"{tmp_path}/missing")

    exported = Library.from_str(tokenizer_store.tokenizer_json(trained))
    assert exported.encode("Bonjour [PAD] le monde").ids == library.encode("Bonjour [PAD] le monde").ids
    tokenizer_store.write_tokenizer_json(trained, f"{tmp_path}/json")
    assert model_of_ours(tokenizer_store.read_tokenizer_json(spark, f"{tmp_path}/json")) == model_of(library)
    library.save(f"{tmp_path}/tokenizer.json")
    assert model_of_ours(tokenizer_store.read_tokenizer_json(spark, f"{tmp_path}/tokenizer.json")) == model_of(library)


def test_symbols_beyond_the_basic_plane(spark, texts, trained, monkeypatch):
    """Ids of 63,232 and more are characters that regular expressions see as two; the result is the same."""
    word = "".join(joins.symbol(i) for i in (63_300, 63_400, 10))
    pairs = spark.createDataFrame([(word, 3)], "word string, cnt bigint")
    from lexmill.operators.vocabulary import pair_counts

    assert {row["pair"]: row["cnt"] for row in pair_counts(pairs).collect()} == {word[:2]: 3, word[1:]: 3}
    runs = bpe.fragments(pairs, [word[:2]]).collect()
    assert [row["word"] for row in runs] == [word[:2]]


def test_a_full_vocabulary_equals_the_library(spark):
    """32,000 tokens, the default, on the texts of the next larger table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    library = train_library([row["text"] for row in rows.orderBy("text").collect()], 32_000)
    assert model_of_ours(bpe.train_bpe(rows)) == model_of(library)


def test_full_queries_have_the_ids_of_the_library(spark):
    """Encoding, truncation and evaluation run on the default vocabulary."""
    from lexmill.plans.catalog import QUERIES

    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    library = train_library(list(given.values()), bpe.VOCAB_SIZE)
    expected = {i: library.encode(text).ids for i, text in given.items()}
    size = library.get_vocab_size()
    assert size > 300 and QUERIES["vocabulary_full"](spark, SF_DIR).count() == size
    encoded = {r["doc_id"]: [int(x) for x in r["ids"].split()] for r in QUERIES["encode_full"](spark, SF_DIR).collect()}
    assert encoded == expected and max(map(max, filter(None, expected.values()))) > 300
    clipped = {r["doc_id"]: r for r in QUERIES["truncate_tokens_full"](spark, SF_DIR).collect() if r["doc_id"] >= 0}
    assert {i: [int(x) for x in r["tokens"].split()] for i, r in clipped.items()} == {i: x[:512] for i, x in expected.items()}
    assert all(r["truncated"] == (len(expected[i]) > 512) for i, r in clipped.items())
    stats = QUERIES["corpus_stats_full"](spark, SF_DIR).collect()[0]
    assert stats["max_tokens"] == max(map(len, expected.values()))
    assert QUERIES["evaluate_full"](spark, SF_DIR).collect()[0]["num_tokens"] > 0


def test_only_changed_words_are_counted_again(spark):
    """Signed differences of the words that hold a merged pair give the counts of all words."""
    from lexmill.functions.joins import symbol

    rng = random.Random(4)
    letters = [symbol(i) for i in (7, 8, 9, 10, 60_000)]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 7))): rng.randint(1, 9) for _ in range(400)}
    state = spark.createDataFrame([(word, cnt, None) for word, cnt in words.items()], "word string, cnt bigint, before string")
    counts = {row["pair"]: row["cnt"] for row in bpe.count_pairs(state).collect()}
    settled = [(letters[0] + letters[1], symbol(61_000)), (symbol(61_000) + letters[2], symbol(61_001)), (letters[3] * 2, symbol(61_002))]
    merged = bpe.apply_merges(state, settled)
    held = {word for word in words if letters[0] + letters[1] in word or letters[3] * 2 in word}
    assert {row["before"] for row in merged.filter("before is not null").collect()} == held
    for row in bpe.count_changes(merged).collect():
        counts[row["pair"]] = counts.get(row["pair"], 0) + row["cnt"]
    again = {row["pair"]: row["cnt"] for row in bpe.count_pairs(merged).collect()}
    assert {pair: cnt for pair, cnt in counts.items() if cnt} == again


def test_written_rounds_change_nothing(spark, monkeypatch):
    texts = spark.createDataFrame([(f"{'ab' * (i % 5)} {'cab' * (i % 3)} abba {i}",) for i in range(60)], "text string")
    monkeypatch.setattr(bpe, "ROUNDS_TO_WRITE", 1)
    one = bpe.train_bpe(texts, 60, frequent_pairs=2).merges.orderBy("rank").collect()
    monkeypatch.setattr(bpe, "ROUNDS_TO_WRITE", 1000)
    assert one == bpe.train_bpe(texts, 60, frequent_pairs=2).merges.orderBy("rank").collect()


def test_the_most_frequent_pairs_reach_the_driver_from_one_task(spark, capsys):
    """An ordered limit that is collected itself sends the first rows of every partition."""
    counts = spark.range(5000).selectExpr("cast(id as string) AS pair", "id % 40 AS cnt").repartition(16)
    few = bpe.most_frequent(counts, 7)
    few.explain()
    assert "Coalesce 1" in capsys.readouterr().out and few.rdd.getNumPartitions() == 1
    assert [(row["pair"], row["cnt"]) for row in few.collect()] == [(str(39 + 40 * i), 39) for i in sorted(range(125), key=lambda i: str(39 + 40 * i))[:7]]


def test_rounds_have_as_many_partitions_as_the_words(spark, monkeypatch):
    seen, collected = [], bpe.most_frequent

    def watched(counts, rows):
        seen.append(counts.rdd.getNumPartitions())
        return collected(counts, rows)

    monkeypatch.setattr(bpe, "most_frequent", watched)
    texts = spark.createDataFrame([(f"{'ab' * (i % 5)} {'cab' * (i % 3)} abba {i}",) for i in range(60)], "text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        bpe.train_bpe(texts, 60, frequent_pairs=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) > 3 and max(seen) <= 2 * spark.sparkContext.defaultParallelism


def test_encoding_in_slices_changes_nothing(spark, texts, trained, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "" if i % 11 == 0 else text) for i, text in enumerate(texts + TRICKY)]
    df = spark.createDataFrame(rows, "i int, text string").coalesce(1)
    whole = encoding.encode(df, trained).orderBy("i").collect()
    monkeypatch.setattr(encoding, "SLICE_WORDS", 3)
    assert encoding.encode(df, trained).orderBy("i").collect() == whole


def test_slices_hold_at_most_so_many_words():
    lists = pa.array([["a"] * 4, None, [], ["b"] * 9, ["c"], ["d"] * 4, ["e"]], pa.list_(pa.string()))
    parts = [part.to_pylist() for part in joins.row_slices(lists, 5)]
    assert sum(parts, []) == lists.to_pylist()
    assert [sum(len(row or []) for row in part) for part in parts] == [4, 9, 5, 1]
