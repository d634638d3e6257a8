"""The build: staging -> star -> validation -> marts, in a fixed stage order.

* Every build goes to a new folder and is published only when it is complete
  and valid (``sources.warehouse``): a failed build leaves the good one as it
  was, and the duplicate legs always belong to the fact beside them.
* The assertions that need staging alone run before any star table is built.
* Writes are observed: totals and checks of staging and fact come with the jobs
  that write them; neither is read again to check it.
* The keyed fact lies in files of consecutive keys, which follow the hours, so
  time filters skip whole files by their statistics.
* Marts read the written fact (pruned to their columns, grouped on account
  keys); account ids are joined to the few result rows.
* Marts are tiny (at most a few hundred rows): each is written as one file
  for BI import. The fact and the account dimension are never exported.
"""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import quality, star
from ledgerlens.plans import views
from ledgerlens.plans.model import Ledger
from ledgerlens.plans.registry import BI_MARTS, MARTS, normalise
from ledgerlens.session import delete_path
from ledgerlens.sources import warehouse

@dataclass
class BuildResult:
    out_dir: str
    build: str
    stage_seconds: dict = field(default_factory=dict)
    headline: dict = field(default_factory=dict)


def _write(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(path)


def _write_observed(df: DataFrame, path: str, metrics: list[Column]) -> dict:
    """Write and return the metrics of the rows written."""
    seen = Observation()
    _write(df.observe(seen, *metrics), path)
    return seen.get


FACT_FILE_ROWS = 1_000_000
SMALL_FILE_ROWS = 20_000


def in_key_order(fact: DataFrame, rows: int) -> DataFrame:
    """The fact in files of consecutive transaction keys. Keys are 1..rows in
    order of time, so the partition of a key is arithmetic (no sampling), files
    hold a stretch of hours (time filters skip files, not just row groups) and the
    aggregates by day or by words of keys shrink within each task."""
    spark = fact.sparkSession
    files = max(-(-rows // FACT_FILE_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // SMALL_FILE_ROWS)), 1)
    at = F.expr(f"CAST(least({files - 1}, (transaction_key - 1) * {files} div {max(rows, 1)}) AS INT)")
    return fact.repartitionById(files, at).sortWithinPartitions("transaction_key")


def build_star(spark: SparkSession, stg: DataFrame, build: str, timings: dict | None = None, observed: dict | None = None) -> Ledger:
    """Write staging, check it, then write dimensions, the keyed fact and the
    duplicate legs. Raises ``quality.ValidationError`` before the dimensions
    are built if an assertion on staging fails. What the writes of staging and
    fact observed, and the dimensions' ranges, are left in ``observed``."""
    timings = timings if timings is not None else {}
    observed = observed if observed is not None else {}
    t = time.time()
    staging = observed["staging"] = _write_observed(stg, os.path.join(build, "stg_transactions"), quality.staging_metrics())
    quality.raise_violations(quality.staging_violations(staging))
    ledger = Ledger.from_staging(spark, spark.read.parquet(os.path.join(build, "stg_transactions")))
    timings["staging"] = time.time() - t

    t = time.time()
    dims = [
        (star.dim_date_between(spark, staging["first_step"], staging["last_step"]), "dim_date", True),
        (ledger.dim_type, "dim_transaction_type", True),
        (ledger.fee_model, "fee_model", True),
        (ledger.accounts, "dim_accounts", False),
    ]
    with ThreadPoolExecutor(max_workers=len(dims)) as pool:  # independent jobs
        list(pool.map(lambda d: _write(d[0], os.path.join(build, d[1]), single_file=d[2]), dims))
    timings["dimensions"] = time.time() - t

    t = time.time()
    read = lambda name: spark.read.parquet(os.path.join(build, name))
    written = {"accounts": read("dim_accounts"), "dim_date": read("dim_date")}
    keyed = Ledger(spark, ledger.stg, written)
    ranges = observed["ranges"] = quality.dimension_ranges(written["dim_date"], ledger.dim_type, written["accounts"])
    fact = in_key_order(keyed.fact, staging["staging_rows"])
    observed["fact"] = _write_observed(fact, os.path.join(build, "fact_transactions"), quality.fact_metrics(ranges))
    timings["fact"] = time.time() - t

    t = time.time()
    written["fact"] = read("fact_transactions")
    _write(Ledger(spark, ledger.stg, written).duplicate_legs, os.path.join(build, "duplicate_cashout_legs"))
    timings["duplicate_legs"] = time.time() - t
    ledger.release()  # the keyed rows now live in the written tables
    keyed.release()
    return Ledger.from_warehouse(spark, build)


def build_marts(
    ledger: Ledger,
    out_dir: str,
    names: list[str] | None = None,
    timings: dict | None = None,
    concurrency: int = 4,
) -> None:
    """Write the marts. Each mart is a small job graph over the shared
    projections; several are submitted at once so the scheduler can overlap
    their small stages (on a large cluster each job still gets the cluster)."""
    timings = timings if timings is not None else {}

    def one(name: str) -> tuple[str, float]:
        t = time.time()
        _write(normalise(MARTS[name](ledger)), os.path.join(out_dir, "marts", name), single_file=True)
        return name, time.time() - t

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        for name, secs in pool.map(one, names or BI_MARTS):
            timings[f"mart:{name}"] = secs


MEASURES = [
    "measure_cards", "measure_fraud_pct_gross_profit", "measure_daily_value_complete", "measure_value_7d_avg",
    "measure_fraud_rate", "measure_rule_recall", "measure_take_rate", "measure_is_loss_making",
    "profit_heatmap", "product_mix",
]


def build_measures(spark: SparkSession, out_dir: str, timings: dict | None = None) -> None:
    """BI measures over the written marts (a few hundred rows each)."""
    from ledgerlens.operators import measures

    timings = timings if timings is not None else {}
    source = measures.WrittenMarts(spark, os.path.join(out_dir, "marts"))
    t = time.time()
    for name in MEASURES:
        _write(normalise(getattr(measures, name)(source)), os.path.join(out_dir, "measures", name), single_file=True)
    timings["measures"] = time.time() - t


def run(spark: SparkSession, stg: DataFrame, out_dir: str, marts: list[str] | None = None) -> BuildResult:
    """Full rebuild into a new folder under ``out_dir``, published at the end.
    Raises ``quality.ValidationError`` (nothing is published) when a check
    fails."""
    build = warehouse.new_build(out_dir)
    result = BuildResult(out_dir, build)
    try:
        observed: dict = {}
        ledger = build_star(spark, stg, build, result.stage_seconds, observed)
        t = time.time()
        quality.validate_written(ledger, **observed)
        result.stage_seconds["validate"] = time.time() - t
        build_marts(ledger, build, marts, result.stage_seconds)
        if marts is None:
            build_measures(spark, build, result.stage_seconds)
        kpi = spark.read.parquet(os.path.join(build, "marts", "dashboard_kpi")).collect()
        result.headline = kpi[0].asDict() if kpi else {}
        warehouse.publish(spark, out_dir, build)
    except BaseException:
        delete_path(spark, build)
        raise
    if marts is None:
        views.after_publish(spark, out_dir)
    return result
