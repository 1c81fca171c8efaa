import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talkgauge.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def trio(spark):
    """Six messages of three people on three days, with equal times."""
    rows = [
        (1, "Alice", "Bob", "Hey Bob, how is it going?", datetime(2025, 12, 1)),
        (2, "Bob", "Alice", "Good, you?", datetime(2025, 12, 1)),
        (3, "Alice", "Bob", "Did you see the race?", datetime(2025, 12, 2)),
        (4, "Bob", "Alice", "Yes, amazing!", datetime(2025, 12, 2)),
        (5, "Alice", "Charlie", "Nice weather today.", datetime(2025, 12, 3)),
        (6, "Charlie", "Alice", "Coffee?", datetime(2025, 12, 3)),
    ]
    return spark.createDataFrame(rows, "msg_id bigint, sender string, receiver string, text string, ts timestamp")
