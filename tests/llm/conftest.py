import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Frames in the shape of ``documents``."""
    def make(rows, extra=False):
        full = [(d, t, None if d is None else "en", None if i % 5 == 4 else f"src{i % 3}", None) for i, (d, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS).repartition(3, "doc_id")
        if not extra:
            return df
        # names that operators use themselves
        from pyspark.sql import functions as F
        return df.withColumns({n: F.lit("x") for n in (
            "k", "tag", "key", "part", "size", "shard", "_key", "component", "tokens", "words", "n_words", "kept", "bitmap", "_text")})

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, ties, repeated rows, a very long text, and texts that differ only in case or blanks."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
    return [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \n\t "), (5, "A  b\nc"), (None, "a b c"), (None, None), (None, "q r s t"),
            (6, long), (7, long), (8, "z" * 100_000), (9, "é😀 ñ"), (10, "a b c d e f g h " * 30), (11, "x"), (12, "x")]
