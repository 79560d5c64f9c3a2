"""Tags, character references, wiki references and the share of letters."""

import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import markup
from lexmill.functions.cleaning import strip_nested_templates
from lexmill.operators.corpus import keep_prose


def applied(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [row["text"] for row in rows.select("i", function("text").alias("text")).orderBy("i").collect()]


TAGS = {
    "<p>a</p><br/>b": " a  b", "a<!-- <b> --> c": "a  c", "a<!-- b": "a ", "a <!-- b --> c <!-- d": "a   c  ", "<script>if (a < b) x</script>y": " y",
    "<STYLE type='x'>p {}</style >z<script>never": " z ", "1 < 2 > 0": "1 < 2 > 0", "a <b c <i>d": "a <b c  d", "<!DOCTYPE html><?xml?>e": "  e", "": "", "&lt;b&gt;": "<b>",
    "&amp;lt; &#233;&#xE9;&#XE9; &eacute; &nosuch; &amp &#; &#x110000; &#0; &#xD800; &#99999999999999999999;": "&lt; ééé é &nosuch; &amp &#; � � � �",
    "&&amp;;&#65;&#66;": "&&;AB", "&NotEqualTilde;": "≂̸", "a;b&c": "a;b&c",
}


def test_strip_tags(spark):
    assert dict(zip(TAGS, applied(spark, markup.strip_tags, TAGS))) == TAGS
    assert applied(spark, markup.strip_tags, [None]) == [None]


@pytest.mark.parametrize("unit", ["<", "<!--", "<script", "<script>", "<a ", "&", "&#1", "&amp;", "<b", ";"])
def test_hostile_texts_take_linear_time(spark, unit):
    start = time.time()
    rows = spark.range(1).select(F.repeat(F.lit(unit), 1_000_000 // len(unit)).alias("text")).select(F.length(markup.strip_tags("text")))
    assert rows.collect()[0][0] >= 0
    assert time.time() - start < 20


REFS = {
    "a<ref/>b": "ab", 'a<ref name="x" />b': "ab", "a<ref>x</ref>b": "ab", "a<ref>x<ref>y</ref>z</ref>b": "ab", "a<ref>x": "a<ref>x", "a</ref>b": "a</ref>b", "<ref>a<ref>b</ref>": "<ref>a",
    "<REF group='n'>{{cite|<ref>q</ref>}}\n</Ref >x": "x", "<references/>": "<references/>", "<ref>{{a}} {{b</ref>c}}": "c}}", "{{a<ref>}}</ref>|b}}c": "c", "": "", "<": "<",
}


def test_strip_refs(spark):
    composed = {text: strip for text, strip in REFS.items() if "{{a<ref>" not in text}
    assert dict(zip(composed, applied(spark, markup.strip_refs, composed))) == composed
    assert applied(spark, lambda text: strip_nested_templates(markup.strip_refs(text)), ["{{a<ref>}}</ref>|b}}c"]) == ["c"]
    assert applied(spark, markup.strip_refs, [None]) == [None]


def test_many_refs_take_linear_time():
    start = time.time()
    assert markup.without_refs("<ref>" * 200_000) == "<ref>" * 200_000
    assert markup.without_refs("<ref>" * 100_000 + "</ref>" * 100_000) == ""
    assert time.time() - start < 10


def test_letter_share_and_filter(spark):
    texts = ["", " \n\xa0", "abc", "a1b2", "1234", "é漢字 ا", "é!", None]
    shares = applied(spark, markup.letter_share, texts)
    assert shares == [0.0, 0.0, 1.0, 0.5, 0.0, 1.0, pytest.approx(2 / 3), None]
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    assert {row["text"] for row in keep_prose(rows, 0.5).collect()} == {"abc", "a1b2", "é漢字 ا", "é!"}
    assert keep_prose(rows, 0.0).count() == 6
