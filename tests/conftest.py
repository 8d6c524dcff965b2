import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revaxis.schema import REVIEW_SCHEMA  # noqa: E402
from revaxis.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture
def make_reviews(spark):
    """Reviews from ``(id, app, rating, text[, votes])`` tuples, one minute apart."""
    from datetime import datetime, timedelta

    def make(*rows):
        start = datetime(2024, 1, 1)
        full = [
            (str(r[0]), r[1], "user", r[2], r[3], start + timedelta(minutes=i), r[4] if len(r) > 4 else 0)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, REVIEW_SCHEMA)

    return make
