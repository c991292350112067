"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(20, 120), 4000) for _ in range(40)]
    passage = sentence(rng, 60, 4000)
    out: list[str | None] = [*base, base[0], base[0], base[1].upper(), None, "", " \t\n ", "one", "one two", "one two", "ONE two"]
    for i in range(6):  # near copies of one text
        parts = base[2].split()
        parts[rng.randrange(len(parts))] = f"x{i}"
        out.append(" ".join(parts))
    out += [f"{sentence(rng, 30, 4000)} {passage} {sentence(rng, 20, 4000)}" for _ in range(4)]
    out += [sentence(rng, 40, 3) + " " + " ".join(["again"] * 90), "é\u00a0ü 漢字 \u2028 x", sentence(rng, 6000, 4000)]
    return out


def rows(seed: int = 1) -> list[tuple]:
    found = texts(seed)
    out = [(7 * i - 20, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(found)]
    return [*out, out[3], out[3]]  # repeated rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns named like those that operators use."""
    from pyspark.sql import functions as F

    return documents.select("*", *(F.lit("x").alias(c) for c in ("score", "part", "key", "h", "n", "cid", "size", "rank", "token", "start")))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def as_rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
