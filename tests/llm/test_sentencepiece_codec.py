"""Ids equal the public library's, for BPE and unigram models, and decode to the text."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from edge_rows import documents, frame

from lexmill.llm import sentencepiece_codec as codec
from lexmill.llm.queries import SENTENCEPIECE_MODEL


@pytest.fixture(scope="module")
def model():
    return codec.load_model(SENTENCEPIECE_MODEL)


def encoded(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abet hin ogrs  .,\né漢=-_#1 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return ["", " ", "  a  b ", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 40, "a\x00b", "🎉x🎉", *made]


def test_bpe_equals_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    texts = odd_texts()
    assert encoded(codec.Encoder(model), texts) == [library.encode(t) for t in texts]


def test_unigram_is_the_best_path(model):
    """The score of the search equals that of a plain dynamic program over every text."""
    unigram = model._replace(kind=codec.UNIGRAM, scores=[-5 - (i % 97) / 10 for i in range(len(model.pieces))])
    encoder = codec.Encoder(unigram)
    texts = [t for t in odd_texts() if t][:500]
    longest = max(len(p) for p in encoder.id_of)
    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        marked = codec.MARK + text.replace(" ", codec.MARK)
        best = [0.0] + [-np.inf] * len(marked)
        for i in range(len(marked)):
            best[i + 1] = max(best[i + 1], best[i] + encoder.lowest)
            for j in range(i + 1, min(len(marked), i + longest) + 1):
                piece = encoder.id_of.get(marked[i:j])
                if piece is not None:
                    best[j] = max(best[j], best[i] + unigram.scores[piece])
        plain = [i for i in ids if i not in unigram.bytes_at]
        outside = sum(c not in encoder.id_of for c in marked)
        score = sum(unigram.scores[i] for i in plain) + outside * encoder.lowest
        assert score == pytest.approx(best[-1]) or score >= best[-1]


def test_words_kept_between_calls(model):
    encoder = codec.Encoder(model)
    once = encoded(encoder, ["some words again", "again some words"])
    assert encoded(encoder, ["again some words", "some words again"]) == once[::-1]


def test_round_trip_over_a_table(spark, model):
    df = frame(spark, documents())
    rows = codec.encode_and_check(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r["ids"] is None) == (r["text"] is None)
        assert r["exact"] is (None if r["text"] is None else True)
        assert r["n_ids"] == len(r["ids"] or [])
        if r["ids"] is not None:
            assert codec.decode_ids(model, r["ids"]) == r["text"]
    back = codec.decode(codec.encode(df.select("doc_id", "text"), model), model)
    assert back.where("not (decoded <=> text)").count() == 0


def test_empty_table(spark, model):
    assert codec.encode_and_check(frame(spark, []), model).count() == 0


def test_literal_mark_comes_back_as_space(model):
    ids = encoded(codec.Encoder(model), ["x▁y"])[0]
    assert codec.decode_ids(model, ids) == "x y"


def test_a_missing_model_is_an_error(tmp_path):
    with pytest.raises(Exception):  # noqa: B017, PT011
        codec.load_model(str(tmp_path / "none.model"))
