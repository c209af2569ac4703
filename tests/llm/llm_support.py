"""Fixtures that the tests of this folder import."""

import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session", autouse=True)
def worker_path(spark):
    from nextcover.llm.queries import prepared

    prepared(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with columns whose names the operators use themselves."""

    def make(rows):
        data = [(i, t, "x", "y", 7, "z") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, hash string")

    return make
