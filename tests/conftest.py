import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from touchline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="touchline-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def scratch(spark, tmp_path_factory):
    """A fresh folder under the session's checkpoint dir (shared storage on a cluster)."""
    import uuid

    from touchline.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"
