import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, fp string, token int, block string"


@pytest.fixture(scope="session")
def odd_rows():
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "src1"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "src2"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "src2"),
        (3, None, "en", "src1"), (4, "", None, None), (None, "no id at all", "fr", "src3"), (None, None, None, None),
        (5, long, "de", "src0"), (6, "été 中文 \U0001f600 under the MIT License", "fr", "src1"), (7, "   \n\t ", "en", "src0"),
        (8, "a@b.com and A@B.com, +1 (988) 555-2485, 10.0.0.1 <|endoftext|>", "en", "src0"), (9, "one", "es", None),
    ]
    return [(*r, len(r[1] or ""), "x", "y", 1, "z") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
