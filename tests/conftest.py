import pytest

from laminet.session import local_session


@pytest.fixture(scope="session")
def spark():
    spark = local_session(4, shuffle_partitions=4, memory="4g")
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()
