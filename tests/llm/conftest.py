import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """A few documents of every awkward kind, with names that operators might use themselves as extra columns."""
    rnd = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta", "iota\n", "kappa", "1984", "the"]
    texts = [" ".join(rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(30, 400))) for _ in range(24)]
    near = texts[3] + " tail"
    texts += [texts[3], texts[3], near, None, "", " \n\t ", "x", "word " * 3000, "a" * 20_000, "ÀÉ 你好     🙂 <|endoftext|>"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[3], "en", "src1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
