import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a very long text, odd white space."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   ", None), (4, "\n\n", "b"), (5, "One line\nTwo  lines \n\tthree", "b"), (5, "One line\nTwo  lines \n\tthree", "b"),
        (None, "no id\nhere", "c"), (6, "Äpfel ÄPFEL   naïve x é 'S don't 12345 <|endoftext|>", None), (7, "word " * 30_000, "d"), (8, " lead and trail ", "d"), (8, "same id, other text", "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)
