import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(40_000))
    same = "The same line of text that several documents share.\nAnd another one of their lines.\n" + " ".join(f"t{k}" for k in range(60))
    near = same.replace("t59", "u59")
    rows = [
        (1, same, "a", 1), (2, same, None, 2), (2, same, None, 2), (3, near, "b", None), (4, None, "c", 4), (5, "", "d", 5), (6, " \n\t\n", "e", 6),
        (7, long, "f", 7), (8, long + " tail", "g", 8), (9, "x" * 200_000, "h", 9), (10, "short", "i", 10), (11, "é日本\n" * 50, "j", 11), (None, same, "k", 12), (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long")


@pytest.fixture
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, n long")


@pytest.fixture
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
