import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus="4", shuffle=2)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
