import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citeweave.schema import COLLECTION_SCHEMA  # noqa: E402
from citeweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app_name="citeweave-tests")
    yield s
    s.stop()


@pytest.fixture
def scratch():
    """A fresh scratch folder per test (never reused, never deleted by the tests)."""
    return tempfile.mkdtemp(prefix="citeweave-test-")


def rows(df, order=None):
    """Collected rows as tuples, sorted for order-free comparison."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out


def collection(spark, data):
    """A collection frame from tuples
    (ingest_id, title, authors, date_pub, source, journal, abstract_, affiliations)."""
    return spark.createDataFrame(data, COLLECTION_SCHEMA)
