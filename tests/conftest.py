import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from formloom.session import local_session
    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def outline(spark, pts, key=1):
    return spark.createDataFrame([(key, [(float(x), float(y)) for x, y in pts])],
                                 "id long, coo array<struct<x:double,y:double>>")
