import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old stone bridge today", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog near the old stone bridge today", "en", "src0"),
    (3, "the quick brown fox jumps over the lazy dog near the old stone bridge  today", "en", "src1"),
    (4, "Ein ganz anderer Satz über Häuser und Straßen in einer großen Stadt am Fluss\nZweite Zeile hier mit einigen Worten", "de", "src1"),
    (5, None, "en", "src2"),
    (6, "", None, None),
    (7, " \n\t ", "en", "src0"),
    (8, "word " * 3000, "en", "src3"),
    (9, "Zweite Zeile hier mit einigen Worten\n\nzweite zeile hier mit einigen worten", "de", "src1"),
    (10, "12 34 !!", "en", "src1"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, and a column whose name the operators use themselves."""
    rows = [(*r, 0, "clash") for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
