import pytest

#: Null, empty and blank texts, ties, repeated rows, a long text, unusual characters.
_WORDS = [f"w{i}" for i in range(60)]
TEXTS = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "Alpha beta gamma delta"), (7, "alpha BETA gamma delta"),
    (8, " ".join(_WORDS)), (9, " ".join([*_WORDS[:59], "other"])), (10, " ".join(reversed(_WORDS))), (11, "123 456 !!"), (12, "日本語のテキスト 中文 🙂 é x"),
    (13, "line one of a text\n" + " ".join(_WORDS[:30]) + "\nlast line"), (14, "another first line\n" + " ".join(_WORDS[:30]) + "\nanother end"), (15, "word " * 30_000), (None, "a row without an id"),
    (16, "before the passage some words stand here " + " ".join(f"p{i}" for i in range(60)) + " and after it others"), (17, "quite another beginning of a line " + " ".join(f"p{i}" for i in range(60)) + " then another end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names an operator might use itself."""
    rows = [(k, t, "en" if k and k % 2 else None, f"src{i}", None, i, "x", 0.5, "y") for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls int, score string, kept double, removed string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
