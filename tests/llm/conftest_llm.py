import random

import pytest

#: Names that the operators use inside, as extra columns of their input.
CLASHES = ("score", "kept", "size", "fp", "start", "u", "h", "label", "id", "row", "place", "piece", "target", "taken", "rank", "vector", "held_out", "sid", "bucket")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(made))


def awkward_rows() -> list[tuple]:
    long = prose(1, 30_000)
    rows = [
        (None, prose(2, 60), "en", "a", 1), (None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", "b", 0),
        (3, " \n\t ", None, "b", 4), (4, "word", "en", None, 4), (5, long, "en", "a", len(long)), (6, "9" * 50_000, "en", "a", 50_000),
        (7, "x" * 80_000, "en", "a", 80_000), (8, prose(3, 100), "en", "a", 1), (9, prose(3, 100), "en", "a", 1),
        (10, prose(4, 100), "fr", "c", 1), (10, prose(4, 100), "fr", "c", 1), (10, prose(5, 100), "fr", "c", 1),
        (11, "la " * 400, "fr", "c", 1), (12, "éß \U0001f600 \u00a0 nbsp line", "de", "b", 9), (13, "!!! ??? 123", "de", "b", 11),
        (14, "a@b.cd 10.0.0.1 card 4111 1111 1111 1111 +1 (555) 123-4567", "en", "a", 1),
    ]
    return rows + [(100 + i, prose(1000 + i, 40 + i), ("en", "fr")[i % 2], "abc"[i % 3], None) for i in range(30)]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shown(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)
