import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillspark.session import build_session, clear_work  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session("tests", "local[8]", 4, **{
        "spark.sql.warehouse.dir": str(warehouse),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    clear_work(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
