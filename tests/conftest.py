import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from docprep.session import local_session

    session = local_session("tests", "4", partitions=2)
    # Tiny inputs: compiling each plan would cost more than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""

    def collect(df, *columns):
        out = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in out.collect()), key=repr)

    return collect
