import hashlib

import public_tokenizers
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, `a b` string"
LABELS = "doc_id long, quality int, toxic int, text string"


def prose(k: int, n: int = 60) -> str:
    """Plain sentences of words that differ with k and the place."""
    parts = "am bri can del em for gar har is jun ket lan mea nec or".split()
    out = []
    for i in range(n):
        h = hashlib.md5(f"{k}/{i}".encode()).digest()
        out.append("".join(parts[x % 15] for x in h[: 2 + h[9] % 3]))
    return " ".join(w if i % 9 else w.capitalize() for i, w in enumerate(out)) + "."


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows,
    columns whose names operators use inside."""
    rows = [
        (0, prose(0), "en", "s", 5, "n", "x", "y"),
        (0, prose(0), "en", "s", 5, "n", "x", "y"),
        (1, prose(0), None, None, None, None, None, None),
        (2, None, "en", "s", 0, "n", "x", "y"),
        (3, "", "en", "s", 0, "n", "x", "y"),
        (4, " \n\t ", "en", "s", 4, "n", "x", "y"),
        (None, prose(3), "en", "s", 4, "n", "x", "y"),
        (None, None, None, None, None, None, None, None),
        (5, "one two", "en", "s", 7, "n", "x", "y"),
        (6, "one two", "en", "s", 7, "n", "x", "y"),
        (7, prose(7, 30_000), "en", "s", 7, "n", "x", "y"),
        (8, "x" * 70_000, "en", "s", 7, "n", "x", "y"),
        (9, prose(9) + " you are a st0000pid idiot", "en", "s", 7, "n", "x", "y"),
        (10, "日本語 😀 é\n" + prose(10), "ja", "s", 7, "n", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, int(k % 3 == 0), "t") for k in range(40)] + [(None, None, None, None), (1, None, 1, None), (1, 0, 0, "u")]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


def collect(frame, *order):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
