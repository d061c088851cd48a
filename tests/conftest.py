import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lumenframe.session import local_session

    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def split_small_keys(spark):
    """Every key with more than five rows counts as hot, every column has too many values."""
    spark.conf.set("lumenframe.hotRows", "5")
    spark.conf.set("lumenframe.exactValues", "3")
    yield
    spark.conf.unset("lumenframe.hotRows")
    spark.conf.unset("lumenframe.exactValues")
