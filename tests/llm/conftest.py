import pytest

from siftline.session import ship_package

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def prose():
    """A text of ``size`` words that depends on ``seed`` alone."""
    import random

    def text(seed, size):
        chosen = random.Random(seed)
        return " ".join(chosen.choice(WORDS) + str(chosen.randrange(50)) for _ in range(size))

    return text


ODD_SCHEMA = "doc_id long, text string, id string, text_hash int, score string, spans string, c0 int, key int, found int"


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Null ids and texts, empty and blank texts, a very long one, copies, repeated rows, columns with clashing names."""
    long = prose(1, 30_000)
    texts = [
        (1, prose(2, 120)), (2, prose(2, 120)), (2, prose(2, 120)), (3, None), (4, ""), (5, " \t\n"), (6, long),
        (None, prose(2, 120)), (None, None), (7, "one"), (7, "two words"), (8, "é " * 60 + "ﬁ▁x  y z "), (9, "x"),
        (10, prose(3, 60) + "\n" + prose(4, 70)), (11, prose(5, 30) + " " + prose(4, 70)), (12, long + " end"),
    ]
    return spark.createDataFrame([(*row, "a", 1, "s", None, 2, 3, 4) for row in texts], ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
