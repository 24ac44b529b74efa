import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """make(seed, words): invented prose."""

    def make(seed, n):
        r = random.Random(seed)
        parts = ["the", "in", "er", "tion", "on", "and", "re", "ou", "th", "is", "ha", "li", "a", "mo", "ké", "st"]
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]
        return " ".join(w.capitalize() if r.random() < 0.1 else w + r.choice(["", "", "", ".", ",", ".\n"]) for w in words)

    return make


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Documents with copies, near copies, a giant text, nulls, empties, repeated rows and columns whose names clash with operators' own."""
    base = [prose(i, 60 + 7 * i) for i in range(24)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(12)]  # exact copies
    near = base[5].split(" ")
    rows += [(200 + i, " ".join([*near[: 5 + i], f"changed{i}", *near[6 + i :]])) for i in range(8)]
    rows += [(300, base[7] + " " + base[8]), (301, "x y " + base[8][50:]), (302, prose(99, 30000))]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "two words"), (405, "a"), (None, base[2]), (None, None), (7, base[7]), (7, base[7])]
    full = [(k, t, "en", "s", len(t or ""), 1, "e", 0.5, [1], True) for k, t in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, fp long, key string, score double, ids array<int>, component boolean").repartition(5).cache()


@pytest.fixture(scope="session")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
