import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, h string, n int, task long, row long"


def rows_of(texts):
    """Documents with columns whose names the operators use inside."""
    return [(i, t, "en", f"s{i % 3}" if i and i % 5 else None, len(t or ""), 1, 2, "x", 3, 4, 5) for i, t in texts]


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def texts(words):
    r = random.Random(6)
    base = [" ".join(r.choice(words) for _ in range(r.randint(60, 300))) for _ in range(40)]
    passage = " ".join(r.choice(words) for _ in range(120))
    out = [(i, t) for i, t in enumerate(base)]
    out += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "Two  words"), (45, "é ü ß  ."), (46, base[3]), (46, base[3]), (47, base[3].upper()), (48, base[4] + " extra")]
    out += [(49, passage + " " + base[5]), (50, base[6] + "\n" + passage), (51, " ".join(base[7:20] * 12)), (52, "ab " * 700), (None, base[8]), (None, None), (53, "x" * 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
