import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """A function of a seed and a length that gives words in order of chance."""

    def make(seed: int, n: int, words=WORDS) -> str:
        r = random.Random(seed)
        return " ".join(f"{r.choice(words)}{r.randrange(40)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Rows with everything that may be missing, empty, long or repeated, and columns with clashing names."""
    long = "\n".join(prose(i, 300) for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, prose(4, 40)), (5, prose(4, 40)), (6, long), (7, long + " more"), (8, prose(8, 3)), (8, prose(8, 3)),
        (None, prose(9, 30)), (None, None), (10, "x" * 300_000), (11, "é😀 日本語 ok"), (12, prose(12, 30)), (12, prose(13, 30)),
    ]
    clash = {"n_words": 1, "toxicity": 2.5, "rep": "a", "root": 3, "hit_spans": "b", "n_entities": "c", "g": 4, "_gone": 5, "line_no": 6}
    names = ["doc_id", "text", "lang", "source", "n_chars", *clash]
    data = [(k, t, None, None, None, *clash.values()) for k, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, toxicity double, rep string, root int, hit_spans string, n_entities string, g int, _gone int, line_no int").select(names)
