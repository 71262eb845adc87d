import os
import sys
from pathlib import Path

import pytest

# Small matrices: threads of the linear algebra would only wait for each other.
for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
    os.environ.setdefault(name, "1")

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from furrow.session import local_session

    session = local_session(4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
