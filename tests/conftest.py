import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (small fixtures only)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
