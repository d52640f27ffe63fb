import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelcast.schema import HISTORY  # noqa: E402
from panelcast.session import local_session  # noqa: E402
from panelcast.sources.scratch import Scratch  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "panelcast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    folder = Scratch(spark)
    yield folder
    folder.close()


@pytest.fixture
def facts(spark):
    """Build a history from ``(periode, bu, ca)`` rows; the other keys have one value each."""

    def build(rows):
        full = [
            (p, bu, "c", "o", "p", None if ca is None else Decimal(ca), Decimal(0))
            for p, bu, ca in rows
        ]
        return spark.createDataFrame(full, HISTORY)

    return build


@pytest.fixture
def lists(spark):
    """Build dimension lists from ``key=[values]``."""

    def build(**members):
        rows = [(k, v, i) for k, values in members.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "dim string, value string, ord int")

    return build


@pytest.fixture
def micro(facts, lists):
    """A history worked by hand: two facts in a month, an orphan, a null measure, a series
    without facts."""
    history = facts(
        [
            ("2021-01", "A", "4"),
            ("2021-01", "A", "6"),
            ("2021-02", "Z", "99"),
            ("2021-03", "A", "30"),
            ("2021-03", "A", None),
            ("2021-04", "A", "5"),
        ]
    )
    return history, lists(bu=["A", "B"], ctt=["c"], ope=["o"], pthrough=["p"])


AS_OF = dt.date(2021, 5, 10)
