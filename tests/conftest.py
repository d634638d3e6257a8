import os
import sys
from decimal import Decimal as D

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.schemas import STAGING_SCHEMA  # noqa: E402

# The 9-row micro-fixture with hand-computed answers (see FIXTURES.md §4).
MICRO_ROWS = [
    (1, "TRANSFER", D("1000.00"), "C1", D("1000"), D("0"), "C2", D("0"), D("0"), 1, 0),
    (1, "CASH_OUT", D("1000.00"), "C3", D("1000"), D("0"), "C4", D("500"), D("1500"), 1, 0),
    (2, "CASH_OUT", D("10000000.00"), "C5", D("10000000"), D("0"), "C6", D("0"), D("10000000"), 1, 0),
    (24, "CASH_OUT", D("0.00"), "C7", D("0"), D("0"), "C4", D("1500"), D("1500"), 1, 0),
    (25, "PAYMENT", D("150.00"), "C1", D("200"), D("0"), "M1", D("0"), D("0"), 0, 0),
    (25, "CASH_IN", D("300.00"), "C8", D("100"), D("400"), "C2", D("1000"), D("700"), 0, 0),
    (26, "DEBIT", D("800.00"), "C9", D("800"), D("0"), "C4", D("0"), D("800"), 0, 0),
    (26, "TRANSFER", D("2000000.00"), "C10", D("0"), D("0"), "C2", D("0"), D("2000000"), 0, 0),
    (26, "TRANSFER", D("300000.00"), "C11", D("300000"), D("300000"), "C3", D("0"), D("0"), 1, 1),
]

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    s = local_session(4, 4, app="ledgerlens-tests")
    yield s
    s.stop()


def staging_df(spark, rows):
    return spark.createDataFrame(rows, STAGING_SCHEMA)


@pytest.fixture()
def micro(spark):
    from ledgerlens.plans.model import Ledger

    return Ledger.from_staging(spark, staging_df(spark, MICRO_ROWS))


@pytest.fixture()
def micro_rows():
    return list(MICRO_ROWS)
