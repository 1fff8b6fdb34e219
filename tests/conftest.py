import pytest

from limelight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan():
    """Physical plan of a DataFrame as text, before it runs."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
