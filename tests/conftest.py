"""A local session shared by all tests, and the small test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from fluxloom.session import ensure_checkpoint_dir, local_session, workers_find_package

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    workers_find_package(session)
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    if not TABLES.exists():
        pytest.skip("no test tables here")
    return str(TABLES)
