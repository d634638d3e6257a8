"""Command line: full rebuild, then the headline figures.

    python -m ledgerlens --csv s3://bucket/ledger/*.csv --out s3://bucket/warehouse
    python -m ledgerlens --events-dir /root/testdata/sf0.1 --out /tmp/warehouse

Run it through ``spark-submit`` on a cluster; with no master configured it
starts a local session.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from ledgerlens.plans import pipeline
from ledgerlens.sources import read_staging_csv, staging_from_sf_dir


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlens", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="ledger CSV file(s) with the 11-column header")
    src.add_argument("--events-dir", help="folder with events.parquet (test data mapped to staging)")
    ap.add_argument("--out", required=True, help="warehouse folder (a new build is published in it)")
    args = ap.parse_args(argv)

    if os.environ.get("PYSPARK_GATEWAY_PORT"):  # launched by spark-submit: use its configuration
        spark = SparkSession.builder.appName("ledgerlens").getOrCreate()
    else:
        from ledgerlens.session import local_session

        spark = local_session()
    stg = read_staging_csv(spark, args.csv) if args.csv else staging_from_sf_dir(spark, args.events_dir)
    result = pipeline.run(spark, stg, args.out)
    print(json.dumps({"headline": result.headline,
                      "stage_seconds": {k: round(v, 2) for k, v in result.stage_seconds.items()}}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
