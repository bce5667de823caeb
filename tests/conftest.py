import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lexloom.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", memory="4g", shuffle_partitions=4)
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("test tables not present")
    return str(DATA)
