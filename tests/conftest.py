import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from cadenza.plans.session import local_session, ship_package

    session = local_session(4, shuffle_partitions=4)
    ship_package(session)
    yield session
    session.stop()
