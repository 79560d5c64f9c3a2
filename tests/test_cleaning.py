import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.functions import cleaning

GOLDEN = [
    ("=== T ===", "="),
    ("==== T ====", "t"),
    ("{{a {{b}} c}}", "c}}"),
    ("[[Catégorie:X|é]] z", "z"),
    ("[[catégorie:X]]", "[[catégorie:x]]"),
    ("{{a\nb}}", "{{a\nb}}"),
    ("a==x\ry==b", "ab"),
    (" x\u0085", "x"),
    ("a==x\ny==b", "a==x\ny==b"),
    ("", ""),
]


def run(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    return [row[0] for row in rows.select(expression).collect()]


def test_golden(spark):
    assert run(spark, [text for text, _ in GOLDEN], cleaning.clean_text("text")) == [clean for _, clean in GOLDEN]


def test_missing_text_stays_missing(spark):
    assert run(spark, [None], cleaning.clean_text("text")) == [None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="{}[]=:Catégorie \n\r\u0085　xX", max_size=60), min_size=1, max_size=40))
def test_no_removable_span_is_left(spark, texts):
    """Each step leaves no span of its own on any line that it did not make itself by joining what stood around one."""

    def spans(text, opening, closing):
        return sum(closing in line[at + len(opening) :] for line in text.split("\n") for at in range(len(line)) if line.startswith(opening, at))

    for step, opening, closing in (
        (cleaning.strip_templates, "{{", "}}"),
        (cleaning.strip_categories, "[[Catégorie:", "]]"),
        (cleaning.strip_headings, "==", "=="),
    ):
        made = run(spark, texts, step("text"))
        for text, cleaned in zip(texts, made):
            assert (cleaned == text) == (spans(text, opening, closing) == 0)
            assert cleaned.count("\n") == text.count("\n")
            assert spans(cleaned, opening, closing) <= spans(text, opening, closing)
    trimmed = run(spark, texts, cleaning.lower_trim("text"))
    assert all(text == text.lower() and not text[:1].isspace() and not text[-1:].isspace() for text in trimmed)


@pytest.mark.parametrize(
    "text, plain",
    [
        ("a {{b {{c}} d\n{{e}}}} f", "a  f"),
        ("{{open {{x}} y", "{{open  y"),
        ("x}} {{a}}", "x}} "),
        ("{{{{a}}}}{{", "{{"),
        ("{{" * 5000 + "}}" * 5000 + "z", "z"),
        ("", ""),
        (None, None),
    ],
)
def test_nested_templates(spark, text, plain):
    assert run(spark, [text], cleaning.strip_nested_templates("text")) == [plain]


@pytest.mark.parametrize("text, blank", [(" \t 　", True), ("", True), (" x ", False)])
def test_is_blank(spark, text, blank):
    assert run(spark, [text], cleaning.is_blank("text")) == [blank]


def test_whitespace_is_what_strip_removes():
    stripped = {chr(point) for point in range(0x110000) if chr(point).strip() == ""}
    assert set(cleaning.WHITESPACE) == stripped
