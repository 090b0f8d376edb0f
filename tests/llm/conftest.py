import pytest

#: Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size bigint, copies int, component_id bigint, "
           "row_hash bigint, key string, _text string, start bigint, lines string")


@pytest.fixture(scope="session")
def edge(spark):
    texts = [(1, "the cat sat on the mat and slept there all day", "en", "a"), (2, "the cat sat on the mat and slept there all day", "en", "b"),
             (2, "the cat sat on the mat and slept there all day", "en", "b"), (3, None, "en", None), (4, "", None, "a"), (5, " \t\n ", "fr", None),
             (None, "le chat dort sur le tapis", "fr", "b"), (6, LONG, "en", "c"), (7, "42 17", None, "c"), (8, "x", "fr", "a"), (8, "another text", "en", "a")]
    return spark.createDataFrame([(*t, 0, "r", 1, 2, 3, 4, "k", "t", 5, "l") for t in texts], COLUMNS)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
