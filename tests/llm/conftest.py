import random

import pytest

ODD_DOCS = [
    (0, "The same short text, twice.", "en", "s"), (1, "The same short text, twice.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "de", "s"),
    (5, "word", "en", None), (6, "Ünïcode — çà 你好 text <|endoftext|> <|STARTOFTEXT|> ﬁn", "fr", "t"), (7, "ab" * 30_000, "en", "hot"), (7, "another row of the same id", "en", "hot"), (None, "no id at all", "en", "hot"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(5)]
    rows = list(ODD_DOCS)
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        rows.append((100 + k, rng.choice([". ", "\n"]).join(parts), "en", "hot"))
    rows += [(200 + k, rows[20][1] + (" tail" if k % 2 else ""), "en", "hot") for k in range(12)]
    full = [(*r, len(r[1] or ""), 1, 0.5, 2, "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp int, score double, part int, ids string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
