import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use themselves
    "place long, node long, bucket int, words string, n_words long, kept boolean, text_sha256 string, mark long, root long, value string, key string, `odd name` string, shard int, epoch int"
)


def frame(spark, rows):
    extra = (7, 7, 7, "x", 7, True, "x", 7, 7, "x", "x", "x", 7, 7)
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *extra) for i, t, g, s in rows], SCHEMA)


def cases():
    """Nulls in every column, blank, tiny and very long texts, ties, repeated rows, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeèñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(60)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, None, "en", "src1"), (2, "", "en", None), (3, " \t\n\v\f\r", None, "src1"), (4, "one", "de", "src2"), (5, "one two", None, None),
        (6, base, "en", "src1"), (7, base, "en", "src1"), (8, base.replace(" ", "\n"), "en", "src2"), (9, " ".join(near), "en", "src3"),
        (9, " ".join(near), "en", "src3"), (None, base, "en", "src1"), (None, "lonely null", None, None), (None, None, None, None),
        (10, text(40) + " " + passage + "\n" + text(30), "fr", "src1"), (11, text(10) + " " + passage, "fr", "src2"), (12, passage + " " + passage, "es", "src1"),
        (13, text(30_000), "en", "src1"), (14, "x" * 30_000, "en", "src4"), (15, "### $$$ *** 123", "en", "src4"), (16, "ÉÑ Σ ΑΣ <|endoftext|> it's 12½", "fr", "src4"),
        (17, "w " * 300, "de", "src4"), (18, "a b\na b\na b\n\n \n", "de", "src4"),
    ]
    rows += [(100 + k, text(rng.randint(1, 90)), rng.choice(["en", "de", "fr"]), f"src{rng.randint(1, 5)}") for k in range(60)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def distinct(rows):
    """The cases with ids of their own."""
    return [(1000 + k, t, g, s) for k, (_, t, g, s) in enumerate(rows)]
