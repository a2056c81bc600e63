import pytest


@pytest.fixture(scope="session")
def shipped(spark):
    from typeweave.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture
def docs(shipped):
    """Documents from rows of (doc_id, text), with columns whose names clash with the operators' own."""

    def make(rows):
        clashing = "id long, row string, digest string, spans string, score string, of long"
        return shipped.createDataFrame([(k, t, 7, "r", "d", "s", "x", 3) for k, t in rows], f"doc_id long, text string, {clashing}")

    return make
