import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(n, seed):
    x, out = seed * 2654435761 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 50))
    return " ".join(out)


LONG = prose(30_000, 99)
BASE = prose(120, 1)
#: Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names operators use inside.
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "b"), (2, BASE, "en", "b"), (3, BASE.replace("alpha", "zulu", 1), None, "c"), (4, "", "en", None), (5, None, "en", "a"),
    (None, prose(60, 2), None, None), (6, LONG, "de", "a"), (7, " \t\n ", "de", "b"), (8, "one", "fr", "c"), (9, prose(80, 3) + "\n" + prose(40, 1), "en", "a"), (10, "shared line of some words\n" + prose(70, 4), "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, id long, key string, score double, units long, row string, n long, size long, model int, part int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", 0.5, 2, "r", 3, 4, 5, 6) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (99, 1, 1), (None, 0, 0), (9, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
