import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chirpframe.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


def rows(frame, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in frame.select(*order).collect() if True), key=repr) if order else sorted(
        (tuple(r) for r in frame.collect()), key=repr
    )
