from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path.insert(0, os.path.abspath(ROOT))
sys.path.insert(0, os.path.dirname(__file__))

from gavelspark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="gavelspark-test-")
    session = build_session(
        "tests", "*", **{"spark.sql.shuffle.partitions": "3", "spark.checkpoint.dir": shared}
    )
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="gavelspark-files-")
