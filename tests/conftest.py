import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vecstrata.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    session.sparkContext.setCheckpointDir(f"file://{shared}")
    yield session
    session.stop()
