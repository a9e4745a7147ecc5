from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from opslens.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="opslens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def src_small(spark):
    from opslens.sources.fixtures import bind_driver_tables

    return bind_driver_tables(spark, SF_SMALL)
