import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, block string, row int, mix string"

LONG = "the quick brown fox jumps over one lazy dog and runs far away from here " * 40
TEXTS = [
    None, "", " \t\n ", "one", "One  two\nthree", LONG, LONG, LONG + "x", "äöü ß 漢字 🎉 it's we'll  ", "a" * 3000,
    "mail me at a.b@example.org or 10.0.0.1", "x" * 99, "y" * 100, "y" * 101, LONG.upper(),
]


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, copies, a repeated row, a repeated id, a null id, null columns."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t or ""), "f", 1, "b", 2, "m") for i, t in enumerate(TEXTS)]
    return [*rows, rows[5], (4, "another text under a taken id", "de", "s0", None, None, None, None, None, None), (None, LONG, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    """From a file, which reads the same rows in the same order again."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
