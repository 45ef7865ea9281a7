import pytest

from marginalia.session import builder, prepare


@pytest.fixture(scope="session")
def spark():
    session = builder("local[4]", shuffle_partitions=3).config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()
