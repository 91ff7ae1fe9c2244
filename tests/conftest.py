import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from helpline.session import build_session
    s = build_session("local[4]", app="helpline-tests", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():  # tests only: private checkpoint folder
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helpline-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
