import pytest

from weftlink.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
