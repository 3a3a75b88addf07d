import random

import pytest

#: Rows that operators must take: nulls, empty and long texts, copies, near copies, one id twice.
WORDS = "the of and to in is that for de la und el one two three four five six".split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) * (pick.random() < 0.7) for _ in range(words))


@pytest.fixture(scope="session")
def hard_rows():
    long = prose(1, 6000)
    rows = [(i, prose(i, 60 + i)) for i in range(2, 20)]
    rows += [(20, None), (21, ""), (22, "   \n\t "), (None, prose(3, 63)), (None, None), (23, long), (24, long), (25, long + " end")]
    rows += [(26, "a b c " * 50), (27, "line of words here\n" * 9), (28, "é中🙂 " * 30), (29, "x" * 30_000)]
    rows += [(5, prose(5, 65)), (5, prose(5, 65)), (30, prose(7, 67).upper()), (31, "one two"), (32, "one")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """Those rows with columns whose names the operators use themselves."""
    clash = "id string, rid long, w string, fp long, at int, row string, kept string, key int, n_chars long"
    rows = [(d, t, "s", 1, "w", 2, 3, "r", "k", 4, None if t is None else len(t)) for d, t in hard_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}").repartition(3)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
