"""Small document tables with the odd cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, h string, a long, b long, node string, score string, kept string, phrases string"

SYLLABLES = {
    "en": "the and ing tion er ent on re st ou th ea is of".split(),
    "fr": "le de que ent eau oi ou çon é tion re la un".split(),
    "de": "der ung sch ein keit ich tz ü be ver die ge".split(),
}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def row(doc_id, text, lang=None, source=None):
    """A row with extra columns whose names operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), -1, -2, "h", 7, 8, "x", "y", "z", "p")


def edge_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        row(1, None),
        row(2, ""),
        row(3, " \t\n "),
        row(4, "word"),
        row(4, "word"),
        row(5, "!!! ... ???"),
        row(None, "a text without an id, of some words, but of no copies"),
        row(6, long, "en", "src0"),
        row(7, long, "en", "src0"),
        row(8, "ünï 漢字   x\x00y", "de"),
        row(9, "a a a a a a a a " * 60),
    ]


def documents(seed=5, n=60):
    """Prose with exact copies, near copies and shared passages, and the odd cases."""
    rng = random.Random(seed)
    rows = []
    shared = prose(rng, "en", 70)
    for i in range(100, 100 + n):
        lang = ("en", "fr", "de")[i % 3]
        text = prose(rng, lang, rng.randint(5, 220))
        if i % 5 == 0:
            text = f"{prose(rng, lang, rng.randint(0, 30))}\n{shared} {text}"
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1]
        if i % 11 == 0 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append(row(i, text, lang, f"src{i % 4}"))
    return rows + edge_rows()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
