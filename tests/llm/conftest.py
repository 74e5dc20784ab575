import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, bucket long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeilnorst", k=rng.randint(1, 9))) for _ in range(n))


def corpus():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages, odd characters."""
    rng = random.Random(5)
    passage = words(rng, 120)
    base = words(rng, 300)
    rows = [
        (1, None), (2, ""), (3, "   \n\n "), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, base), (8, base), (9, base.replace(" ", "\n", 4)), (10, base[:-9] + "changed end"), (11, base + " " + passage),
        (12, words(rng, 80) + " " + passage + " " + words(rng, 90)), (13, passage + passage), (14, "é ß Ünï   \x1c 漢字 😀 <|endoftext|> a<|startoftext|>b " + words(rng, 20)), (15, "abc " * 3000), (16, "x" * 2500), (17, words(rng, 12000)),
        (18, "mail a.b@c.example.org and a.b@c.example.org, call +1 (555) 123-4567 at 10.0.0.1 or 999.1.1.1 card 4111 1111 1111 1111, 4111111111111112 zorblatt"),
        (19, "again a.b@c.example.org zorblatt is here"), (20, "zorblatt a.b@c.example.org"), (21, "clean text about zorblaxx and nothing"), (22, base),
    ]
    rows += [(30 + k, words(rng, rng.randint(1, 60))) for k in range(25)]
    rows += [(60 + k, " ".join(w if rng.random() > 0.02 else "zz" for w in base.split())) for k in range(12)]
    rows += [(8, base), (99, "same row"), (99, "same row")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0" if k % 2 else None, len(t) if t is not None else None, -1, 0.5, 3) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
