import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, words string"
SYLLABLES = "the of and tion ing her wh st th re an on es ed is for".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(9)
    texts = [sentence(rng, 60) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t), True, 0.5, "w") for i, t in enumerate(texts)]
    rows += [(10, None, None, None, None, None, None, None), (11, "", "en", "s", 0, True, 0.1, ""), (12, " \n\t ", "en", "s", 4, True, 0.1, ""), (None, texts[0], "en", "s", 1, True, 0.1, "")]
    rows += [rows[1], rows[1], (13, "one", "de", "s", 3, False, 0.2, "x"), (14, "one", "de", "s", 3, False, 0.2, "x"), (15, texts[2] + " end", "en", "s", 1, True, 0.1, "")]
    rows += [(16, " ".join(sentence(rng, 50) for _ in range(400)), "en", "s", 1, True, 0.1, ""), (17, "Ünïcödé 東京 <|endoftext|> Σς ½ \x85 x", "fr", "s", 1, True, 0.1, "")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
