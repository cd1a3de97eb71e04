import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.session import build_session

    session = build_session("tests", "local[8]", 4, **{
        "spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stages")),
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
