import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nextcover.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": shared}
    return local_session(shuffle_partitions=4, memory="4g", settings=settings)


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Frames that a module's tests cache are not there for the next module's."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def tables(spark):
    from workload.views import Tables

    return Tables(spark, SF_DIR)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
