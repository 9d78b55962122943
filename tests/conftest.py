import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quadrangle.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, app_name="quadrangle-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def campus(spark):
    from quadrangle.sources.fixtures import Campus
    return Campus(spark, SF_SMALL)
