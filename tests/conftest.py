import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from driftline.session import local_session
    s = local_session(8, 4)
    yield s
    s.stop()


@pytest.fixture()
def narrow(spark):
    """Force tiny chunks, so that every ordered operator crosses many chunk edges."""
    spark.conf.set("driftline.chunk.seconds", "250000")
    yield spark
    spark.conf.unset("driftline.chunk.seconds")
