"""The command-line full rebuild on the smallest fixture."""

import json
import os
import tempfile

from tests.conftest import SMOKE_DIR


def test_cli_rebuild(spark, capsys):
    from ledgerlens.__main__ import main

    out = tempfile.mkdtemp(prefix="ll-cli-")
    assert main(["--events-dir", SMOKE_DIR, "--out", out]) == 0
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["headline"]["total_txns"] == 1025
    from ledgerlens.sources import warehouse

    assert os.path.isdir(os.path.join(warehouse.current(spark, out), "marts", "dashboard_kpi"))
