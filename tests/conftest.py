import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from fathomline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Started on import: test modules build column expressions while they are collected.
SESSION = local_session("tests", 8, "8g")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def one(spark, value, expr, type_="string"):
    """Value of a column expression over a single row with column ``x``."""
    return spark.createDataFrame([(value,)], f"x {type_}").select(expr.alias("y")).first()["y"]
