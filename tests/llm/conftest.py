import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text, source) rows, with an extra column of an internal name."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string").repartition(3)

    return make
