from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakequill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, {"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": f"file://{folder}/shared"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
