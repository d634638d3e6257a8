"""Landing folder -> staging: exactly once across runs and new files."""

import os
import subprocess
import sys
import tempfile

from ledgerlens.operators import risk
from ledgerlens.plans.model import Ledger
from ledgerlens.schemas import CSV_HEADER
from ledgerlens.streaming import land_staging
from tests.conftest import MICRO_ROWS


def _write_csv(path, rows):
    with open(path, "w") as fh:
        fh.write(",".join(CSV_HEADER) + "\n")
        for r in rows:
            fh.write(",".join(str(x) for x in r) + "\n")


def test_landing_is_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="ll-land-")
    landing, staging, ckpt = (os.path.join(root, d) for d in ("landing", "staging", "ckpt"))
    os.makedirs(landing)
    _write_csv(os.path.join(landing, "part-1.csv"), MICRO_ROWS[:5])
    land_staging(spark, landing, staging, ckpt)
    assert spark.read.parquet(staging).count() == 5
    land_staging(spark, landing, staging, ckpt)  # nothing new: nothing appended
    assert spark.read.parquet(staging).count() == 5
    _write_csv(os.path.join(landing, "part-2.csv"), MICRO_ROWS[5:])
    land_staging(spark, landing, staging, ckpt)
    stg = spark.read.parquet(staging)
    assert stg.count() == 9
    attr = {r["attributed_to"]: r["fraud_txns"] for r in risk.fraud_loss_attribution(Ledger.from_staging(spark, stg)).collect()}
    assert attr == {"TRANSFER": 2, "CASH_OUT": 2, "NOT COUNTED (duplicate leg)": 1}


SESSION = """
import sys
from ledgerlens.session import local_session
from ledgerlens.streaming import land_staging
spark = local_session(2, 2, app="landing")
land_staging(spark, *sys.argv[1:4])
print("rows", spark.read.parquet(sys.argv[2]).count())
"""


def test_landing_goes_on_in_another_session():
    """Two processes, each with a Spark session and checkpoint folder of its own."""
    root = tempfile.mkdtemp(prefix="ll-land2-")
    paths = [os.path.join(root, d) for d in ("landing", "staging", "ckpt")]
    os.makedirs(paths[0])
    seen = []
    for part, rows in (("part-1.csv", MICRO_ROWS[:5]), ("part-2.csv", MICRO_ROWS[5:])):
        _write_csv(os.path.join(paths[0], part), rows)
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        env = {**os.environ, "PYTHONPATH": home, "LEDGERLENS_DRIVER_MEMORY": "1g"}
        run = subprocess.run([sys.executable, "-c", SESSION, *paths], env=env, capture_output=True, text=True, timeout=300)
        seen.append(run.stdout.strip().splitlines()[-1] if run.returncode == 0 else run.stderr[-500:])
    assert seen == ["rows 5", "rows 9"]
