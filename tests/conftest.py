import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.schemas import INPUTS  # noqa: E402
from cohortlens.session import local_session  # noqa: E402
from cohortlens.sources import frame_tables  # noqa: E402

AS_OF = datetime(1999, 1, 1)
DDL = {"flag": "int"}


@pytest.fixture(scope="session")
def spark():
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.maxMetadataStringLength": "10000",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"),
    }
    session = local_session(4, "tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    """Build the eleven tables from dicts; columns left out are null, tables left out are empty."""

    def build(ddl=DDL, **rows):
        frames = {}
        for key, (name, columns) in INPUTS.items():
            schema = ", ".join(f"{c} {ddl.get(k, k)}" for c, k in columns.items())
            values = [tuple(r.get(c) for c in columns) for r in rows.get(key, [])]
            for r in rows.get(key, []):
                assert set(r) <= set(columns), set(r) - set(columns)
            frames[name] = spark.createDataFrame(values, schema)
        return frame_tables(frames)

    return build


@pytest.fixture
def rows():
    """A DataFrame as a sorted list of tuples."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return collect
