import pytest

from datalathe.session import SHARED_DIR, local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set(SHARED_DIR, str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def column(spark):
    """One-column DataFrame with the list position as row id."""

    def make(values, kind="double", name="x"):
        return spark.createDataFrame(list(enumerate(values)), f"__row_id long, {name} {kind}")

    return make


@pytest.fixture
def values():
    """Values of a column in row order."""

    def read(df, name="x"):
        return [r[0] for r in df.orderBy("__row_id").select(name).collect()]

    return read
