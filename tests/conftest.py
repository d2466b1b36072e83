import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tools")):
    sys.path.insert(0, path)

from wardlight.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "wardlight-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def sec(spark, folder):
    """The canonical events, held in memory as pandas for brute force."""
    from wardlight.sources import telemetry

    return telemetry.security_events(spark, folder)


@pytest.fixture(scope="session")
def events_pd(sec):
    frame = sec.toPandas()
    frame["ms"] = frame["TimeGenerated"].astype("datetime64[ms]").astype("int64")
    return frame
