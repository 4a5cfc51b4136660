import pytest

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again"), (2, "the quick  brown fox\njumps over the lazy dog AGAIN"), (3, None), (4, ""), (5, " \n\t"), (6, "short one"), (7, "word " * 20_000),
    (8, "Über straße 中文字符 🤦🏼‍♂️ ▁x <|endoftext|> </s>"), (9, "a" * 5_000), (10, "The quick brown fox jumps over the lazy dog again"), (None, "no id here at all today"),
]


@pytest.fixture
def edge(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row and clashing extra columns."""
    rows = [(i, t, "s" if i != 6 else None, 1.0, "x") for i, t in EDGE]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, node string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, extra int")
