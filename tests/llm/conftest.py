import random

import pytest

SYLLABLES = {"en": ["the", "ing", "er", "on", "st", "and", "ly", "wh"], "fr": ["é", "eau", "ou", "ch", "qu", "ai", "le", "eux"], "de": ["sch", "ung", "ß", "ö", "ich", "ver", "pf", "ge"]}


def words(rng, n, lang="en"):
    return [rng.choice(["", "", "", rng.choice(SYLLABLES[lang])]) + "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def prose(rng, n, lang="en"):
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(3, 14))
        out.append(" ".join(words(rng, k, lang)).capitalize() + rng.choice([". ", ".\n"]))
        left -= k
    return "".join(out).strip()


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, white space alone, a text without letters, a repeated row, and specials.
ODD = [None, "", " \n\t ", "123 456", "a", "same text here", "same text here", "x <|endoftext|> y", "é", "z" * 5000]


def frame(spark, texts, lang="en"):
    """A table with extra columns whose names could clash with an operator's own."""
    from pyspark.sql import functions as F

    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({"word": F.lit(1), "part": F.lit("p"), "ids": F.lit(0.5), "n": F.lit(2), "label": F.lit("l")})


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
