import random

import pytest

#: Columns that clash with names the operators use inside.
CLASHES = "digest string, block string, n string, token string, shard string, keep_id string, score string, h1 string, mix_rate string, id string, vec string"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def build(rows):
        full = [(i, t, *(rest or ("en", "src0")), len(t or ""), *(["x"] * 11)) for i, t, *rest in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")

    return build


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages, case changes, nulls, empties and one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 5))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = text(20)
    out = []
    for _ in range(60):
        out.append(text(rng.choice([1, 3, 4, 5, 6, 12, 13, 14, 40, 120])))
    for i in range(0, 40, 2):
        words = out[i].split()
        out.append(out[i])  # exact copy
        out.append(out[i].upper() if i % 4 else out[i].replace(" ", "\n\t"))
        near = words[:]
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [f"{text(7)} {passage} {text(9)}" for _ in range(12)]
    base = text(100).split()
    for i in range(30):  # a large group of near copies
        w = base[:]
        w[i * 3] = f"edit{i}"
        out.append(" ".join(w))
    out += ["", "   \t\n", None, None, "123 !!", text(30000), "x" * 50000]
    return [(i * 7 % 1000 + (i // 143) * 1000, t) for i, t in enumerate(out)]
