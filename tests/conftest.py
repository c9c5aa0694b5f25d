import pytest

from offerloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session()


@pytest.fixture
def frame(spark):
    """Rows and a schema string to a DataFrame over several partitions."""

    def make(rows, schema, partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
