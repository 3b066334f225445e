import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests import golden_tables  # noqa: E402
from tests.compare import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark, tmp_path_factory):
    """The small model the expected results belong to, read from id-keyed TSV tables."""
    from wordloom.sources.tables import read_relational

    folder = tmp_path_factory.mktemp("golden")
    golden_tables.write(folder)
    return read_relational(spark, str(folder), may_lack=["external_links"])


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows_of(df, *columns):
    """Rows as sorted tuples; NULLs sort first."""
    chosen = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in chosen.collect()),
        key=lambda r: [(v is not None, v) for v in r])
