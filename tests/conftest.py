import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from gavel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    checkpoints = str(tmp_path_factory.mktemp("shared"))
    return local_session(8, partitions=4, memory="4g", checkpoints=checkpoints)


@pytest.fixture
def rows(spark):
    """Make a frame from tuples and a schema text."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


def as_dicts(df, *order):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [repr(r[c]) for c in order or df.columns])
