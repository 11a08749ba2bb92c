import random

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, `_text` int, keep_id int, "
    "`class` string, share double, `_id` int, `_gone` int, `_row` int, c0 int, `a.b` int, row int"
)


def prose(seed: int, words: int, syllables: str = "ka lo mi ren tas vor pel dun shi gra") -> str:
    pick = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 80), "xx", "a"), (2, prose(2, 80), "xx", "a"), (3, prose(3, 80), None, None),
        (4, None, "xx", "a"), (5, "", "yy", "b"), (6, " \n\t ", "yy", None), (7, "!!! ???", None, "b"),
        (8, long, "xx", "a"), (9, long, "xx", "a"), (None, prose(4, 30), "yy", "b"), (None, None, None, None),
        (10, "one", "yy", "b"), (11, "one", "yy", "b"), (12, "Ünïcode ß 中文 \U0001f600", "yy", "b"),
        (13, prose(5, 50), "yy", "b"), (13, prose(5, 50), "yy", "b"), (14, "a\n\n\nb\na\n\n\nb", "yy", "b"),
    ]
    return spark.createDataFrame([(*r, None, "x", 1, 2, "c", 0.5, 1, 1, 1, 1, 1, 1) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session", autouse=True)
def in_no_need_of_room():
    """Small tables need no room between phases."""
    from declcensus.llm import tables

    turns, tables._TURNS = tables._TURNS, 0
    yield
    tables._TURNS = turns
