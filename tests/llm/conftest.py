import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, shard int, a long"


def prose(seed, n, stock=("the", "river", "of", "stone", "and", "light", "over", "a", "hill", "sings", "to", "nobody", "while", "rain", "falls")):
    r = random.Random(seed)
    return " ".join(r.choice(stock) + (str(r.randrange(400)) if r.random() < 0.6 else "") for _ in range(n)).capitalize() + "."


def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    out, base = [], prose(1, 60)
    for i in range(40):
        out.append((i, prose(100 + i, 10 + 7 * i)))
    out += [(100, base), (101, base), (102, base.upper()), (103, base + " tail words here"), (104, None), (105, ""), (106, "  \t\n"), (107, "one"), (108, "one two three four"), (109, "ONE two three four")]
    out += [(110, prose(7, 30_000)), (111, base), (111, base), (None, "no key"), (112, "élan vital ÉLAN naïve 日本 text"), (113, "x" * 5000)]
    return [(k, t, "en" if k and k % 2 else None, "s", None, "clash", 5, 9) for k, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
