import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from streamops.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "streamops-tests", shuffle_partitions=4, **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A path factory: each name gives a path that does not exist yet."""
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex[:8]}")


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples of the named columns."""

    def read(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()),
                      key=lambda r: tuple((v is None, str(v)) for v in r))

    return read
