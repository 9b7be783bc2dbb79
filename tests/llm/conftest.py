import random

import pytest

SCHEMA = "doc_id long, text string, gid string, key int, h double, row string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies; clashing extra columns."""
    rnd = random.Random(11)
    vocab = ["alpha", "Beta", "gamma,", "delta", "épsilon", "ζ", "omega.", "the", "of", "and"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    lines = lambda n: "\n".join(say(rnd.randint(1, 9)) for _ in range(n))
    base, passage = lines(12), lines(6)
    texts = [None, "", " ", "\n\n\n", "A", "a", "Ab\tab\x0bAB", "x" * 3000, base, base, base.upper(), base + " tail", base.replace("the", "The"), passage, lines(3) + "\n" + passage + "\n" + lines(3), passage + "\n" + lines(4)]
    texts += [lines(rnd.randint(1, 15)) for _ in range(20)] + [say(4000), "É" * 10, "\U0001f600 <|endoftext|> don't 'll", "12 3.5 %% !!"]
    rows = [(i * 3, t, "g", i, float(i), "r", rnd.choice(["en", "fr", None]), rnd.choice(["s0", None]), len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
