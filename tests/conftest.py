import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work_dir = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[8]", 8, driver_memory="6g", work_dir=work_dir)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    def make(*texts):
        rows = list(enumerate(texts))
        return spark.createDataFrame(rows, "row_id bigint, line string")

    return make
