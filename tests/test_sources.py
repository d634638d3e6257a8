"""CSV contract round trip and the missing-source precheck."""

import os
import tempfile

import pytest

from ledgerlens.schemas import CSV_HEADER
from ledgerlens.sources.staging import read_staging_csv
from tests.conftest import MICRO_ROWS


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ll-csv-")
    path = os.path.join(d, "ledger.csv")
    with open(path, "w") as fh:
        fh.write(",".join(CSV_HEADER) + "\n")
        for r in MICRO_ROWS:
            fh.write(",".join(str(x) for x in r) + "\n")
    got = read_staging_csv(spark, path).orderBy("step", "name_orig", "amount").collect()
    want = sorted(MICRO_ROWS, key=lambda r: (r[0], r[3], r[2]))
    assert [tuple(r) for r in got] == want


def test_missing_source_fails_fast(spark):
    with pytest.raises(FileNotFoundError):
        read_staging_csv(spark, "/nonexistent/ledger.csv")


def test_malformed_row_fails_the_load(spark):
    d = tempfile.mkdtemp(prefix="ll-csv-bad-")
    path = os.path.join(d, "ledger.csv")
    with open(path, "w") as fh:
        fh.write(",".join(CSV_HEADER) + "\n")
        fh.write(",".join(str(x) for x in MICRO_ROWS[0]) + "\n")
        fh.write("1,TRANSFER,not-a-number,C1,0,0,C2,0,0,0,0\n")
    with pytest.raises(Exception):
        read_staging_csv(spark, path).collect()
