import random

import pytest

WORDS = "the of and to in is that for on with as was at by it from be this have are".split()


@pytest.fixture(scope="session")
def rows():
    """Rows of every kind: NULL, empty, blank, short, long, copies, near copies, shared passages, repeated rows."""
    rnd = random.Random(3)
    words = WORDS + ["".join(rnd.choice("abcdeéß中n") for _ in range(rnd.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    shared, base, out = prose(70), prose(120), []
    for i in range(60):
        kind = i % 6
        if kind == 1:
            text = prose(20) + " " + shared + "\n" + prose(15)
        elif kind == 2:
            text = base + " " + rnd.choice(words)
        elif kind == 3:
            text = base
        else:
            text = prose(rnd.randint(0, 90))
        out.append((i, text))
    return [*out, (100, None), (101, ""), (102, "  \n "), (103, "x" * 450), (104, "ab " * 300), (None, shared), (5, out[5][1]),
            (7, prose(40)), (105, prose(4000))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "x", 2.0) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp int, "
                                 "th string, d double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
