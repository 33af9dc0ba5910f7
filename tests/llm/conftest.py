import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "me", "lo", "za") for b in ("n", "ster", "vik", "l", "mond", "sh")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, hot and null sources, empty, null and long texts."""
    rng = random.Random(5)
    shared = text(rng, 60)
    rows = []
    for i in range(120):
        t = text(rng, rng.choice([3, 12, 40, 90]))
        if i % 7 == 0:
            t = f"{t} {shared} {text(rng, 10)}"
        if i % 11 == 5 and rows[-1][1]:
            t = rows[-1][1]
        if i % 13 == 6 and rows[-2][1]:
            t = rows[-2][1] + " more"
        rows.append((i, t, "en", "hot" if i % 3 == 0 else f"s{i % 5}" if i % 10 else None, len(t)))
    rows += [(200, "", "en", "s1", 0), (201, None, None, None, None), (202, "é" * 150 + " ü" + "é" * 150, "fr", "s2", 303)]
    rows += [(203, ("ab" * 40 + " ") * 300, "en", "hot", 0), (204, "\n\n", "en", "s1", 2), (None, "no id here at all", "en", "s1", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clash(docs):
    """The same with columns named like the operators' own, and a repeated row."""
    from pyspark.sql import functions as F

    more = docs.union(docs.filter("doc_id = 3"))
    return more.withColumns({c: F.lit("x") for c in ("fp", "component_id", "rid", "key", "size", "score", "kept", "node", "marks", "ids", "shard", "copies")})
