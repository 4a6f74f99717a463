import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodeframe.session import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def folder(spark):
    import uuid

    from lodeframe.session import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"
