import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import build_session, checkpoint_dir

    s = build_session("local[*]", 8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def inputs(spark):
    from corpusflow.plans.registry import Inputs

    return Inputs(spark, SF_SMALL)
