import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, rank int, found string, language string, copy int, fingerprint long, item_id long"


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, g, s, len(t or ""), 7, "d", 1, "f", "x", 9, 3, 4) for i, t, g, s in rows]
        return spark.createDataFrame(full, DOC)

    return make


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture
def text():
    return prose
