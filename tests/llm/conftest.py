import pytest

from opslens.llm.ship import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, label string"


@pytest.fixture(scope="session")
def spark(spark):
    return ship(spark)


@pytest.fixture
def docs_of(spark):
    """documents with columns whose names clash with those the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows and a null id."""
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(base) for _ in range(n))
    one, two = prose(120), prose(90)
    edited = one.split()
    edited[60] = "changed"
    rows = [
        (1, one), (2, one), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n "), (7, "few words only"), (8, "Few WORDS only"),
        (9, two + " " + one), (10, two.replace(" ", "\x0b\n")), (11, prose(40_000)), (12, "x" * 300_000), (13, prose(12) + " " + two + " " + prose(30)),
        (None, one), (14, two + "   é ß 漢字 🎉"), (15, "É é"), (16, "a b c d e f g h i j k l m"), (17, "z a b c d e f g h i j k l m a b c d e f g h i j k l m"),
    ]
    return rows + [(20 + k, prose(rnd.choice([5, 13, 40, 200]))) for k in range(60)] + [(1, one)]
