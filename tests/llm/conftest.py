import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 4000) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, a passage and a line in many, odd cases."""
    rng = random.Random(5)
    passage, line = " ".join(words(rng, 60)), "the same line in many texts"
    out: list[str | None] = []
    for i in range(40):
        body = words(rng, rng.randrange(50, 400))
        if i % 3 == 0:
            body[20:20] = passage.split()
        text = " ".join(body)
        if i % 4 == 0:
            text += f"\n{line}\nafter it {i}"
        out.append(text)
        if i % 5 == 0:
            out.append(text)
            out.append(text.upper())
        if i % 6 == 0:
            near = text.split(" ")
            near[len(near) // 2] = "changed"
            out.append(" ".join(near))
    out += [None, "", "   \n\t ", "one", "one", "é ü ß", "a a a a a a a a a a a a", "x " * 3000, None, "\x0b \x0c", "<|endoftext|> \\h ### </turn>"]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, None, "s", None) for i, t in corpus] + [(3, corpus[3][1], None, None, None), (None, "null id here", None, None, None), (None, corpus[0][1], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns that operators use inside."""
    return spark.createDataFrame([(1, "some words and more of them", 5, 6, "t", "k", 7)], "doc_id long, text string, id long, _id long, kept string, `key` string, copies long")
