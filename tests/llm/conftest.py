import random

import pytest

EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "Straße İ ﬁ 東京 🙂 naïve\x00end"), (7, "á é Å"),
    (8, "same text here and there"), (8, "same text here and there"), (None, "a row without an id"), (None, None), (9, "line\n\nline\nLine"),
]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """Edge cases, a very long text, copies, near copies and a shared passage."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = list(EDGES) + [(20, text(30_000)), (21, "x" * 40_000)]
    base, passage = text(300), text(120)
    out += [(30 + i, base) for i in range(5)]
    out += [(40 + i, base.replace(base.split()[7 * i + 3], "changed", 1)) for i in range(8)]
    out += [(60 + i, text(40) + "\n" + passage + "\n" + text(30)) for i in range(12)]
    out += [(80 + i, "\n".join(text(9) for _ in range(5))) for i in range(10)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 0, 1.5, "w") for i, t in rows], "doc_id long, text string, key string, n int, score double, words string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
