import pytest
from llm_helpers import CLASHES, prose


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, unusual characters, columns with clashing names."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, prose(1, 60, 4)), (5, prose(1, 60, 4)), (6, prose(2, 20_000, 700)),
        (7, "Héllo wörld – ça va? 漢字 😀 naïve"), (None, prose(3, 40, 2)), (8, prose(4, 12)), (8, prose(4, 12)), (9, "one two"),
        (10, "!!! ### $$$"), (11, "a\r\nb\tc\x0b d\x85e f"),
    ]
    rows = [(i, t, *["x"] * len(CLASHES)) for i, t in texts]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
