"""Key sets as bits, against plain counts; references without joins."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import growth, keysets, quality
from ledgerlens.plans import pipeline
from ledgerlens.plans.model import Ledger
from ledgerlens.sources.staging import staging_from_sf_dir
from tests.conftest import SMOKE_DIR
from tests.test_plans import plan


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_plain_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.choice([None, 1, 64, 65, 2**40, -3, 0, rng.randrange(300)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, k long").repartition(3)
    got = {r["g"]: r["n"] for r in keysets.distinct_keys(df, "k", ["g"], "n").collect()}
    assert got == {g: len({k for h, k in rows if h == g and k is not None}) for g in range(3)}
    keys = [k for _, k in rows if k is not None]
    r = keysets.key_counts(df, "k").first()
    assert (r["total_rows"], r["keyed_rows"], r["distinct_keys"], r["least"], r["greatest"]) == (500, len(keys), len(set(keys)), min(keys), max(keys))


def test_full_ranges(spark):
    frame = lambda keys: (spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    got = keysets.full_ranges(
        {"full": frame(range(5, 400)), "gap": frame([1, 2, 4]), "repeat": frame([1, 2, 2]), "hidden": frame([1, 1, 3]), "null": frame([1, None, 2]), "empty": frame([])}
    )
    assert got == {"full": (5, 399), "gap": None, "repeat": None, "hidden": None, "null": None, "empty": None}


@pytest.fixture(scope="module")
def written(spark):
    out = tempfile.mkdtemp(prefix="ll-keys-")
    return pipeline.build_star(spark, staging_from_sf_dir(spark, SMOKE_DIR), out)


def orphans(fact, L, accounts=None):
    return tuple(quality.check_orphans(fact, L.dim_date, L.dim_type, L.accounts if accounts is None else accounts).first())


def test_orphans_are_counted_without_a_join(written):
    L = written
    p = plan(quality.check_orphans(L.fact, L.dim_date, L.dim_type, L.accounts))
    assert "Join" not in p and p.count("FileScan") == 1 and orphans(L.fact, L) == (0, 0, 0, 0)
    n = L.accounts.count()
    bad = L.fact.withColumn("dest_account_key", F.when(F.col("transaction_key") == 3, F.lit(n + 1)).otherwise(F.col("dest_account_key")))
    bad = bad.withColumn("orig_account_key", F.when(F.col("transaction_key") < 3, F.lit(None)).otherwise(F.col("orig_account_key")))
    bad = bad.withColumn("date_key", F.when(F.col("transaction_key") == 5, F.lit(10**6)).otherwise(F.col("date_key")))
    assert orphans(bad, L) == (1, 0, 2, 1)


def test_a_gap_or_a_repeat_among_accounts_is_joined(written):
    L = written
    key = L.fact.select("dest_account_key").first()[0]
    missing = L.accounts.where(F.col("account_key") != key)
    uses = L.fact.agg(F.count_if(F.col("orig_account_key") == key), F.count_if(F.col("dest_account_key") == key)).first()
    assert orphans(L.fact, L, missing) == (0, 0, uses[0], uses[1]) and uses[1] > 0
    twice = L.accounts.unionByName(L.accounts.where(F.col("account_key") == key))
    assert orphans(L.fact, L, twice) == (0, 0, 0, 0)


def test_repeated_accounts_are_found(written):
    L = written
    one = L.accounts.where(F.col("account_key") == 2)
    doctored = L.accounts.unionByName(one.withColumn("account_id", F.lit("C-new"))).unionByName(one.withColumn("account_key", F.lit(10**7)).withColumn("party_type", F.lit("BANK")))
    assert quality.account_constraints(doctored).first().asDict() == {"account_party_type": 1, "account_id_unique": 1, "account_key_unique": 1}


def test_constraints_scan_each_written_table_once(written):
    L = written
    p = plan(quality.constraint_violations(L.stg, L.dim_date, L.dim_type, L.accounts, L.fee_model, L.fact, L.duplicate_legs))
    assert p.count("FileScan") == 5  # staging, hours, accounts, legs, fact


def test_daily_accounts_from_keys_equal_those_from_ids(spark, written):
    rows = lambda L: sorted(map(tuple, growth.accounts_by_day(L).collect()))
    assert rows(written) == rows(Ledger.from_sf_dir(spark, SMOKE_DIR))
    p = plan(growth.accounts_by_day(written))
    assert p.count("FileScan") == 1 and "bit_or" in p and "count(distinct" not in p.lower()
