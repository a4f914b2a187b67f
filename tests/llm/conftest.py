import random

import pytest

WORDS = [f"w{i}" for i in range(4000)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng: random.Random, s: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in s.split())


@pytest.fixture(scope="session")
def documents(spark):
    """Copies, near copies, shared passages, a hot line, nulls, empties, repeated rows and clashing extra columns."""
    rng = random.Random(4)
    base, passage, rows = text(rng, 120), text(rng, 70), []
    for i in range(60):
        rows.append(text(rng, rng.randint(3, 150)))
    rows += [base] * 8 + [changed(rng, base, 0.02) for _ in range(12)]
    rows += [f"{text(rng, 40)} {passage} {text(rng, 30)}" for _ in range(5)]
    rows += [f"{text(rng, 5)}\nThe very same line, in many documents.\n{text(rng, 5)}" for _ in range(6)]
    rows += [None, "", " \n ", "one", "one two three", "tab\tand  blanks \n\n", "", text(rng, 4000)]
    table = [(i, t, "en", f"src{0 if i % 3 == 0 else i % 5}", len(t or ""), i, "x") for i, t in enumerate(rows)]
    table += [table[3], (None, "no id", "en", None, 5, 0, "x")]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, queue int, key string")
