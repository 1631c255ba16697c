import pytest

from compare import session


@pytest.fixture(scope="session")
def spark():
    s = session(4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "3")  # tables of tests are tiny
    return s
