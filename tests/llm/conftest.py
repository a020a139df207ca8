import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, blk int, row_key string"

WORDS = ["the", "The", "ou", "été", "naïve", "&&&", "|", "x1", "re-do", "a", "b", "c", "日本", "end.", "#tag", "and"]


def make_rows(seed: int = 7, n: int = 60):
    """Documents with copies, shared passages, nulls, blanks, ties, a hot source and long texts."""
    rng = random.Random(seed)

    def words(k):
        return [rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.6 else "") for _ in range(k)]

    passage, other = words(64), words(31)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            body = words(rng.randrange(5, 90))
        elif kind == 1:
            body = words(rng.randrange(0, 40)) + passage + words(rng.randrange(0, 20))
        elif kind == 2 and texts:
            body = rng.choice([t for t in texts if t]).split(" ")
        elif kind == 3:
            body = other * rng.randrange(1, 4) + words(3)
        elif kind == 4:
            body = ["word"] * rng.randrange(0, 70)
        else:
            body = words(rng.randrange(0, 25)) + passage[10:40]
        sep = rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"])
        texts.append(sep.join(body))
    texts += [None, "", "   \n\t ", "one", " ", "A B\x0bC", "Licensed under the MIT License.\nmore text here", " ".join(words(9000))]
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 5 else ("hot" if i % 3 else f"s{i % 4}")
        rows.append((i * 3, t, "en", source, len(t or ""), 5, "clash", 1, "clash"))
    rows.append(rows[4])
    rows.append(rows[4])
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
