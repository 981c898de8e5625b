import pytest

#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, long words, and clashing columns.
ODD = [
    (1, None, "x"), (2, "", None), (3, " \n\t ", "x"), (4, "one", "x"), (5, "one two  three   four", "x"), (5, "one two  three   four", "x"),
    (6, "a" * 5000, "x"), (7, "é" * 700 + " 日本語のテキスト\n\n\n  end ", "x"), (8, "word " * 3000, None), (9, "it's <|endoftext|> we'll see \U0001f600 x", "x"),
    (10, "tail  ", "x"), (None, "no id here", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_words string")
