import pytest

PLANTED = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today\nand then it sleeps under the old oak tree", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today\nand then it sleeps under the old oak tree", "en", "a"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank today\nand then it sleeps under the tall oak tree", "en", "b"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank today\nand then it sleeps under the tall oak tree", "en", "b"),
    (4, None, None, None),
    (5, "", "", ""),
    (6, "   \n\n\t\n", "en", "b"),
    (None, "a row without an id that has some words", "en", "a"),
    (8, "x " * 30_000, "en", "b"),
    (9, "une ligne tout à fait différente, écrite en français pour voir", "fr", "c"),
    (10, "日本語のテキスト 🙂 don't 123", "ja", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, id long, tokens string, score string, n_tokens string, keep string, size long, part int, block binary"
    rows = [(i, t, g, s, len(t) if t is not None else None, 1, "x", None, "y", "z", 2, 3, b"k") for i, t, g, s in PLANTED]
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
