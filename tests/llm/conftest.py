import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, score string, row string, made int, given int, n_words string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls everywhere, empty, white space, very long, repeated rows, and columns whose names the operators use."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Über", "日本", "x1", "the", "of"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two"), (6, "one two three four five six seven eight nine ten eleven"), (6, "one two three four five six seven eight nine ten eleven"), (None, "lost words here"), (None, None), (7, "🙂 emoji é̃ text"), (8, "a" * 50_000)]
    return spark.createDataFrame([(i, t, None, "s", None, "f", "s", "r", 1, None, None) for i, t in texts], DOC)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
