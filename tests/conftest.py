from __future__ import annotations

import pytest

from custodia.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return SMALL


def scripts(spark, *codes: str):
    return spark.createDataFrame(list(enumerate(codes)), "script_id long, code string")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
