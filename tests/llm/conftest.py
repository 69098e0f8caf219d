import random

import pytest

WORDS = "the of and to in is was it for on that with as by at from his her they which you one had but not what all were when we there can an your said if do will each about how up out them then she many some so these would other into has more two him see time could no make than first been".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __digest string, rep long"


def document(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, blanks, repeated rows and long texts."""
    rng = random.Random(11)
    texts = [document(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = document(rng, 70)
    texts += [texts[3], texts[3].replace(" ", "\n\t"), texts[5] + " ", None, "", " \n ", "!!! 123", "x", "é" * 3000, document(rng, 4000)]
    texts += [document(rng, 20) + " " + passage + " " + document(rng, rng.randint(0, 30)) for _ in range(6)]
    texts += [passage, texts[9].replace("the", "thee", 1), texts[10] + " end"]
    rows = [(k, t, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "", None]), len(t or ""), "clash", 7) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (500, None, None, None, 0, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
