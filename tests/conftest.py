import pytest

from clauseworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", app="tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
