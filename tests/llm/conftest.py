import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents of given texts, with ids from 0."""

    def docs(texts, ids=None):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)

    return docs


@pytest.fixture(scope="session")
def real(spark):
    from tests.conftest import SF

    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages", "benchmark", "labels")}
