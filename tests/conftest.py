import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evlens.session import build_session
    s = build_session("local[4]", app="evlens-tests", shuffle_partitions=4,
                      extra={"spark.sql.session.timeZone": "America/New_York",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="evlens-test-shared-")})
    yield s
    s.stop()
