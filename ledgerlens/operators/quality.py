"""Data-quality operators: in-load assertions (A1-A3), the numbered
reconciliation checks (V1-V9) and declared constraints (C1).

Every check is one or a few aggregates over the tables (no per-row driver
work). ``validate`` gathers the checks that carry a verdict into one
``(check, violations, result)`` frame and raises when any fails; the
reference prints FAIL and carries on, we stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import keysets
from ledgerlens.operators.common import beside, money, pct, sum_cents, with_type_names
from ledgerlens.schemas import RESIDUAL_TOLERANCE, STAGING_COLUMNS, TRANSACTION_TYPES


class ValidationError(RuntimeError):
    pass


def _verdict(ok: Column, pass_text: str = "PASS", fail_text: str = "FAIL") -> Column:
    return F.when(ok, F.lit(pass_text)).otherwise(F.lit(fail_text))


def _check_rows(df: DataFrame, check: str) -> DataFrame:
    """(check, violations, result) from a frame with a ``violations`` column."""
    return df.select(
        F.lit(check).alias("check"),
        F.col("violations").cast("long").alias("violations"),
        _verdict(F.col("violations") == 0).alias("result"),
    )


def _as_rows(one: DataFrame, label: str) -> DataFrame:
    """(label, violations) rows from the columns of a one-row aggregate."""
    rows = [F.struct(F.lit(c).alias(label), F.col(f"`{c}`").cast("long").alias("violations")) for c in one.columns]
    return one.select(F.inline(F.array(*rows)))


# -------------------------------------------------- shared check expressions
# Each check is an aggregate expression, so ``validation_report`` can compute
# every staging-level check in one pass over staging and every fact-level
# check in one pass over the fact.

def _is_m(col: str) -> Column:
    return F.left(F.col(col), F.lit(1)) == "M"


def staging_check_exprs() -> dict[str, Column]:
    return {
        "payment_dest_untracked": F.count_if(
            (F.col("type") == "PAYMENT") & ((F.col("oldbalance_dest") != 0) | (F.col("newbalance_dest") != 0))
        ),
        "merchant_never_originates": F.count_if(_is_m("name_orig")),
        "merchant_receives_only_payment": F.count_if(_is_m("name_dest") & (F.col("type") != "PAYMENT")),
        "constraint:staging_not_null": sum([F.count_if(F.col(c).isNull()) for c in STAGING_COLUMNS], F.lit(0)),
        "constraint:staging_flags_zero_one": F.count_if(
            ~F.col("is_fraud").isin(0, 1) | ~F.col("is_flagged_fraud").isin(0, 1)
        ),
    }


def _staging_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("staging_rows"),
        sum_cents("amount").alias("s_c"),
        F.sum(F.col("is_fraud").cast("long")).alias("staging_fraud_rows"),
    ]


def _fact_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("fact_rows"),
        sum_cents("amount").alias("f_c"),
        F.count_if(F.col("is_fraud")).alias("fact_fraud_rows"),
    ]


# ----------------------------------------------------------------- assertions

def assert_payment_dest_untracked(stg: DataFrame) -> DataFrame:
    """A1: PAYMENT destination balances are untracked (all zero)."""
    v = stg.agg(staging_check_exprs()["payment_dest_untracked"].alias("violations"))
    return _check_rows(v, "payment_dest_untracked")


def assert_fraud_bearing(stg: DataFrame, dim_type: DataFrame) -> DataFrame:
    """A2: is_fraud_bearing equals 'type has fraud' for every observed type,
    plus the case the reference's inner join misses: types not in the dim."""
    observed = stg.groupBy("type").agg((F.max("is_fraud") > 0).alias("has_fraud"))
    joined = observed.join(
        F.broadcast(dim_type.select(F.col("type_name").alias("type"), "is_fraud_bearing")), "type", "left"
    )
    known = F.col("is_fraud_bearing").isNotNull()
    v = joined.agg(
        F.count_if(known & (F.col("has_fraud") != F.col("is_fraud_bearing"))).alias("fraud_bearing_flags"),
        F.count_if(~known).alias("known_types"),
    )
    return _as_rows(v, "check").withColumn("result", _verdict(F.col("violations") == 0))


def assert_merchant_rule(stg: DataFrame) -> DataFrame:
    """A3: merchants never originate and only receive PAYMENT (one scan)."""
    e = staging_check_exprs()
    v = stg.agg(
        *[e[name].alias(name) for name in ("merchant_never_originates", "merchant_receives_only_payment")]
    )
    return _as_rows(v, "check").withColumn("result", _verdict(F.col("violations") == 0))


def fee_clamp_cases(spark) -> DataFrame:
    """A4: the fee text that the marts use, on one amount in each of its ranges
    and on both edges. Unit-test input, not a data query."""
    from ledgerlens.functions.fees import fee_sql

    cases = [  # amount, rate, floor, cap, fee
        ("below the floor", 40, 0.02, 2, 75, 2),
        ("on the floor", 100, 0.02, 2, 75, 2),
        ("between", 1250, 0.02, 2, 75, 25),
        ("on the cap", 3750, 0.02, 2, 75, 75),
        ("above the cap", 8_000_000, 0.02, 2, 75, 75),
        ("nothing charged", 8_000_000, 0.0, 0, 0, 0),
    ]
    df = spark.createDataFrame(cases, "case string, amount int, rate double, fee_min int, fee_max int, expected int")
    money = df.selectExpr(
        "case", "CAST(amount AS DECIMAL(18,2)) AS amount", "CAST(rate AS DECIMAL(6,5)) AS rate",
        "CAST(fee_min AS DECIMAL(12,2)) AS fee_min", "CAST(fee_max AS DECIMAL(12,2)) AS fee_max", "expected",
    )
    fee = F.expr(fee_sql("amount", "rate", "fee_min", "fee_max"))
    return money.select("case", fee.alias("fee"), "expected", (fee == F.col("expected")).alias("ok"))


# --------------------------------------------------------- reconciliation V1-V9

def check_row_count(stg: DataFrame, fact: DataFrame) -> DataFrame:
    s = stg.agg(*_staging_totals())
    f = fact.agg(*_fact_totals())
    return beside(s, f).select(
        "staging_rows", "fact_rows", _verdict(F.col("staging_rows") == F.col("fact_rows")).alias("result")
    )


def check_measures(stg: DataFrame, fact: DataFrame) -> DataFrame:
    j = beside(stg.agg(*_staging_totals()), fact.agg(*_fact_totals()))
    ok = (F.col("s_c") == F.col("f_c")) & (F.col("staging_fraud_rows") == F.col("fact_fraud_rows"))
    return j.select(
        money(F.col("s_c")).alias("staging_total_amount"),
        money(F.col("f_c")).alias("fact_total_amount"),
        "staging_fraud_rows",
        "fact_fraud_rows",
        _verdict(ok).alias("result"),
    )


def check_grain(fact: DataFrame) -> DataFrame:
    g = keysets.key_counts(fact, "transaction_key").select("total_rows", "distinct_keys")
    return g.withColumn("result", _verdict(F.col("total_rows") == F.col("distinct_keys")))


# The fact's references: column, dimension, its key, name of the count.
LINKS = [
    ("date_key", "dim_date", "date_key", "orphaned_date_keys"),
    ("transaction_type_key", "dim_type", "transaction_type_key", "orphaned_type_keys"),
    ("orig_account_key", "accounts", "account_key", "orphaned_orig_keys"),
    ("dest_account_key", "accounts", "account_key", "orphaned_dest_keys"),
]


def dimension_ranges(dim_date: DataFrame, dim_type: DataFrame, accounts: DataFrame) -> dict[str, tuple[int, int] | None]:
    """The ranges that the dimensions' keys are proved to fill (one job)."""
    return keysets.full_ranges(
        {"dim_date": (dim_date, "date_key"), "dim_type": (dim_type, "transaction_type_key"), "accounts": (accounts, "account_key")}
    )


def orphan_counts(ranges: dict[str, tuple[int, int] | None]) -> list[Column]:
    """Aggregates over the fact for the references to dimensions without gaps."""
    return [F.count_if(keysets.outside(key, ranges[dim])).alias(name) for key, dim, _, name in LINKS if ranges[dim]]


def check_orphans(fact: DataFrame, dim_date: DataFrame, dim_type: DataFrame, accounts: DataFrame,
                  ranges: dict[str, tuple[int, int] | None] | None = None) -> DataFrame:
    """Fact keys with no dimension row. Where a dimension's keys are proved to
    fill a range, an orphan is a key outside it, counted in the scan of the
    fact; only a dimension with a gap or a repeat is joined, by its distinct keys."""
    dims = {"dim_date": dim_date, "dim_type": dim_type, "accounts": accounts}
    ranges = ranges or dimension_ranges(dim_date, dim_type, accounts)
    rows = fact.select(*[key for key, *_ in LINKS])
    loose = [link for link in LINKS if not ranges[link[1]]]
    for key, dim, dim_key, name in loose:
        keys = dims[dim].select(F.col(dim_key).alias(key)).where(F.col(key).isNotNull()).distinct()
        rows = rows.join(keys.withColumn(name, F.lit(True)), key, "left")
    counts = [*orphan_counts(ranges), *[F.count_if(F.col(name).isNull()).alias(name) for *_, name in loose]]
    return rows.agg(*counts).select(*[name for *_, name in LINKS])


def dimension_row_counts(dim_date: DataFrame, dim_type: DataFrame, accounts: DataFrame, fact: DataFrame) -> DataFrame:
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("dimension"), F.count(F.lit(1)).alias("rows"))

    return (
        n(dim_date, "dim_date")
        .unionByName(n(dim_type, "dim_transaction_type"))
        .unionByName(n(accounts, "dim_accounts"))
        .unionByName(n(fact, "fact_transactions"))
    )


def check_date_dense(dim_date: DataFrame, stg: DataFrame) -> DataFrame:
    """Density of dim_date (tautological by construction) plus the real
    check: every staging step has a dim_date row."""
    d = dim_date.agg(
        F.min("date_key").alias("min_step"), F.max("date_key").alias("max_step"), F.count(F.lit(1)).alias("dim_date_rows")
    )
    missing = (
        stg.select(F.col("step").alias("date_key"))
        .distinct()
        .join(dim_date.select("date_key"), "date_key", "left_anti")
        .agg(F.count(F.lit(1)).alias("steps_missing_from_dim"))
    )
    expected = F.col("max_step") - F.col("min_step") + 1
    return beside(d, missing).select(
        "min_step",
        "max_step",
        "dim_date_rows",
        expected.alias("expected_rows_if_dense"),
        _verdict(F.col("dim_date_rows") == expected, "PASS (dense, no gaps)", "FAIL (gaps present)").alias("result"),
        "steps_missing_from_dim",
    )


def account_coverage(fact: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts by the roles they appear in: one scan, one row for each word of
    64 accounts and the bits of both roles."""
    roles = fact.select(F.inline(F.expr("array(struct(orig_account_key AS k, 1 AS role), struct(dest_account_key AS k, 2 AS role))")))
    in_role = lambda role: F.bit_or(F.when(F.col("role") == role, keysets.bit("k")))
    words = roles.groupBy(keysets.word("k").alias("word")).agg(in_role(1).alias("o"), in_role(2).alias("d"))
    return beside(
        accounts.agg(F.count(F.lit(1)).alias("dim_account_rows")),
        words.agg(
            keysets.bits_of(F.col("o")).alias("distinct_originators"),
            keysets.bits_of(F.col("d")).alias("distinct_destinations"),
            keysets.bits_of(F.col("o").bitwiseAND(F.col("d"))).alias("accounts_in_both_roles"),
        ),
    )


def party_type_split(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("party_type").agg(F.count(F.lit(1)).alias("account_rows")).orderBy(F.col("account_rows").desc())


def _inconsistent(col: str) -> Column:
    return F.abs(F.col(col)) > F.lit(RESIDUAL_TOLERANCE)


def balance_error_by_fraud(facts: DataFrame) -> DataFrame:
    g = facts.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_inconsistent("orig_balance_error")).alias("orig_inconsistent"),
        F.count("dest_balance_error").alias("dest_checkable_rows"),
        F.count_if(_inconsistent("dest_balance_error")).alias("dest_inconsistent"),
    )
    return g.select(
        "is_fraud",
        "rows",
        "orig_inconsistent",
        pct("orig_inconsistent", "rows", 2).alias("pct_orig_inconsistent"),
        "dest_checkable_rows",
        "dest_inconsistent",
        pct("dest_inconsistent", "dest_checkable_rows", 2).alias("pct_dest_inconsistent"),
    ).orderBy("is_fraud")


def balance_error_by_type(facts: DataFrame, dim_type: DataFrame) -> DataFrame:
    g = facts.groupBy("transaction_type_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_inconsistent("orig_balance_error")).alias("o"),
        F.count("dest_balance_error").alias("dc"),
        F.count_if(_inconsistent("dest_balance_error")).alias("d"),
    )
    return with_type_names(g, dim_type).select(
        "type_name",
        "rows",
        pct("o", "rows", 2).alias("pct_orig_inconsistent"),
        pct("d", "dc", 2).alias("pct_dest_inconsistent"),
    ).orderBy(F.col("rows").desc())


def fraud_by_type_star(fact: DataFrame, dim_type: DataFrame) -> DataFrame:
    g = fact.groupBy("transaction_type_key").agg(
        F.count(F.lit(1)).alias("txn_count"), F.count_if(F.col("is_fraud")).alias("fraud_count")
    )
    return with_type_names(g, dim_type, "is_fraud_bearing").select(
        "type_name",
        "is_fraud_bearing",
        "txn_count",
        "fraud_count",
        pct("fraud_count", "txn_count", 4).alias("fraud_pct"),
    ).orderBy(F.col("fraud_count").desc())


# ------------------------------------------------------------------ constraints

def account_constraints(accounts: DataFrame) -> DataFrame:
    """Party types and repeated ids and keys from one scan: each row counts for
    its id and for the word of its key."""
    sides = F.expr("array(struct(true AS by_id, account_id AS id, CAST(NULL AS BIGINT) AS k), struct(false AS by_id, CAST(NULL AS STRING) AS id, account_key AS k))")
    wrong = F.col("by_id") & ~F.col("party_type").isin("CUSTOMER", "MERCHANT")
    groups = accounts.select("party_type", F.inline(sides)).groupBy("by_id", "id", keysets.word("k").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(keysets.bit("k")).alias("bits"), F.count_if(wrong).alias("wrong")
    )
    more = lambda side, n: F.coalesce(F.sum(F.when(side, n)), F.lit(0))
    return groups.agg(
        more(F.col("by_id"), F.col("wrong")).alias("account_party_type"),
        more(F.col("by_id"), F.col("n") - 1).alias("account_id_unique"),
        more(~F.col("by_id"), F.col("n") - F.coalesce(F.bit_count("bits"), F.lit(1))).alias("account_key_unique"),
    )


def nulls(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(missing), F.lit(0)).alias(name))


# Columns of the fact that must be present (dest_balance_error may be missing).
FACT_REQUIRED = [
    "transaction_key", "date_key", "transaction_type_key", "orig_account_key", "dest_account_key", "amount",
    "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest", "orig_balance_error", "is_fraud",
    "is_flagged_fraud",
]


def dimension_constraints(dim_date: DataFrame, dim_type: DataFrame, accounts: DataFrame, fee_model: DataFrame,
                          duplicate_legs: DataFrame) -> list[DataFrame]:
    """One-row aggregates whose columns are the constraints of the dimensions."""
    sign = lambda c: ~F.col(c).isin(-1, 1)
    return [
        dim_date.agg(
            F.count_if(~F.col("hour_of_day").between(0, 23)).alias("dim_date_hour_0_23"),
            F.count_if(F.col("day_number") < 0).alias("dim_date_day_non_negative"),
            (F.count(F.lit(1)) - F.count_distinct("date_key")).alias("date_key_unique"),
        ),
        dim_type.agg(
            F.count_if(sign("orig_balance_sign") | F.coalesce(sign("dest_balance_sign"), F.lit(False))).alias("type_signs_plus_minus_one"),
            (F.count(F.lit(1)) - F.count_distinct("type_name")).alias("type_name_unique"),
        ),
        account_constraints(accounts),
        fee_model.agg(
            F.count_if(~F.col("fee_rate").between(F.lit(0), F.lit(0.10).cast("decimal(6,5)"))).alias("fee_rate_0_to_10pct"),
            F.count_if(F.col("fee_max") < F.col("fee_min")).alias("fee_cap_at_least_floor"),
            (F.count(F.lit(1)) - F.count_distinct("transaction_type_key")).alias("fee_model_key_unique"),
        ),
        keysets.key_counts(duplicate_legs, "transaction_key").select(
            (F.col("total_rows") - F.col("distinct_keys")).alias("duplicate_leg_key_unique")
        ),
    ]


def constraint_violations(stg: DataFrame, dim_date: DataFrame, dim_type: DataFrame, accounts: DataFrame,
                          fee_model: DataFrame, fact: DataFrame, duplicate_legs: DataFrame) -> DataFrame:
    """C1: the declared constraints of the model as counted violations."""
    e = staging_check_exprs()
    parts = [
        stg.agg(*[e[f"constraint:{n}"].alias(n) for n in ("staging_not_null", "staging_flags_zero_one")]),
        *dimension_constraints(dim_date, dim_type, accounts, fee_model, duplicate_legs),
        nulls(fact, FACT_REQUIRED, "fact_not_null"),
    ]
    out = _as_rows(parts[0], "constraint")
    for part in parts[1:]:
        out = out.unionByName(_as_rows(part, "constraint"))
    return out


# -------------------------------------------------------------------- validate

def validation_report(ledger) -> DataFrame:
    """Every verdict-bearing check as (check, violations, result).

    One aggregate pass over staging computes all staging-level checks (and
    its totals), one pass over the fact computes the fact totals and the key
    count; the remaining checks read the small dimensions or join the fact
    to them (anti joins)."""
    stg, fact = ledger.stg, ledger.fact
    exprs = staging_check_exprs()
    stg_row = stg.agg(*_staging_totals(), *[e.alias(f"c{i}") for i, e in enumerate(exprs.values())])
    missing = sum((F.col(c).isNull().cast("int") for c in FACT_REQUIRED), F.lit(0))
    fact_row = fact.agg(
        *_fact_totals(), F.count_distinct("transaction_key").alias("distinct_keys"), F.coalesce(F.sum(missing), F.lit(0)).alias("fact_nulls")
    )
    both = beside(stg_row, fact_row)
    verdicts = [(name, F.col(f"c{i}")) for i, name in enumerate(exprs)] + [
        ("row_count", F.abs(F.col("staging_rows") - F.col("fact_rows"))),
        ("measures", F.when((F.col("s_c") == F.col("f_c"))
                            & (F.col("staging_fraud_rows") == F.col("fact_fraud_rows")), 0).otherwise(1)),
        ("grain", F.col("fact_rows") - F.col("distinct_keys")),
        ("constraint:fact_not_null", F.col("fact_nulls")),
    ]
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), v.cast("long").alias("violations")) for name, v in verdicts
    ])
    shared = both.select(F.inline(rows))
    orph = check_orphans(fact, ledger.dim_date, ledger.dim_type, ledger.accounts).select(
        F.lit("orphans").alias("check"),
        (F.col("orphaned_date_keys") + F.col("orphaned_type_keys") + F.col("orphaned_orig_keys")
         + F.col("orphaned_dest_keys")).alias("violations"),
    )
    dense = check_date_dense(ledger.dim_date, stg).select(
        F.lit("date_dense_and_covering").alias("check"),
        ((F.col("expected_rows_if_dense") - F.col("dim_date_rows")) + F.col("steps_missing_from_dim")).alias(
            "violations"
        ),
    )
    dims = dimension_constraints(ledger.dim_date, ledger.dim_type, ledger.accounts, ledger.fee_model, ledger.duplicate_legs)
    parts = [shared, assert_fraud_bearing(stg, ledger.dim_type).select("check", "violations"), orph, dense] + [
        _as_rows(d.toDF(*[f"constraint:{c}" for c in d.columns]), "check") for d in dims
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("check", F.col("violations").cast("long").alias("violations")))
    return out.select("check", "violations", _verdict(F.col("violations") == 0).alias("result"))


def staging_report(ledger) -> DataFrame:
    """The checks that staging alone decides: A1 to A3 and its constraints."""
    exprs = staging_check_exprs()
    rows = _as_rows(ledger.stg.agg(*[e.alias(n) for n, e in exprs.items()]), "check")
    rows = rows.unionByName(assert_fraud_bearing(ledger.stg, ledger.dim_type).select("check", "violations"))
    return rows.withColumn("result", _verdict(F.col("violations") == 0))


# -------------------------------------------------------- checks of what is written
# A build observes its own writes (``DataFrame.observe``): the tables' totals and
# checks come with the job that writes them, without reading them again. The
# observed frame is the last stage before the files, whose tasks count once even
# if an executor is lost and they run again.

def staging_metrics() -> list[Column]:
    """Totals, checks, types and span of staging, as aggregates of its write."""
    by_type = [F.count_if((F.col("type") == t[1]) & (F.col("is_fraud") > 0)).alias(f"fraud:{t[1]}") for t in TRANSACTION_TYPES]
    seen = [F.count_if(F.col("type") == t[1]).alias(f"seen:{t[1]}") for t in TRANSACTION_TYPES]
    known = F.coalesce(F.col("type").isin([t[1] for t in TRANSACTION_TYPES]), F.lit(False))
    return [
        *[e.alias(name) for name, e in staging_check_exprs().items()],
        *_staging_totals(),
        *by_type,
        *seen,
        F.count_if(~known).alias("rows_of_unknown_type"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
    ]


def fact_metrics(ranges: dict[str, tuple[int, int] | None]) -> list[Column]:
    """Totals, missing values and orphans of the fact, as aggregates of its write."""
    missing = sum((F.col(c).isNull().cast("int") for c in FACT_REQUIRED), F.lit(0))
    return [*_fact_totals(), F.coalesce(F.sum(missing), F.lit(0)).alias("fact_nulls"), *orphan_counts(ranges)]


def staging_violations(seen: dict) -> dict[str, int]:
    """Violations of A1 to A3 and the constraints of staging, from its write."""
    bearing = sum((seen[f"fraud:{t[1]}"] > 0) != bool(t[3]) for t in TRANSACTION_TYPES if seen[f"seen:{t[1]}"])
    return {
        **{name: seen[name] for name in staging_check_exprs()},
        "fraud_bearing_flags": int(bearing),
        "known_types": seen["rows_of_unknown_type"],
    }


def written_violations(staging: dict, fact: dict, ranges: dict[str, tuple[int, int] | None]) -> dict[str, int]:
    """Violations of V1, V2, V4, V6 and of the fact's required columns, from the
    writes of staging and fact and the proved ranges of the dimensions."""
    same = all((a or 0) == (b or 0) for a, b in ((staging["s_c"], fact["f_c"]), (staging["staging_fraud_rows"], fact["fact_fraud_rows"])))
    hours, empty = ranges["dim_date"], staging["first_step"] is None
    covers = empty or hours is not None and hours[0] <= staging["first_step"] and hours[1] >= staging["last_step"]
    return {
        "row_count": abs(staging["staging_rows"] - fact["fact_rows"]),
        "measures": int(not same),
        "orphans": sum(fact.get(name, 0) for *_, name in LINKS),
        **{f"full_range:{name}": int(found is None and not empty) for name, found in ranges.items()},
        "date_dense_and_covering": int(not covers),
        "constraint:fact_not_null": fact["fact_nulls"],
    }


def raise_violations(violations: dict[str, int]) -> None:
    failed = {name: n for name, n in violations.items() if n}
    if failed:
        raise ValidationError("; ".join(f"{name}: {n} violation(s)" for name, n in failed.items()))


def validate_written(ledger, staging: dict, fact: dict, ranges: dict[str, tuple[int, int] | None]) -> dict[str, int]:
    """All checks of a written star. Only what no write can observe reads tables
    again: the fact's keys (one column) and the constraints of the dimensions."""
    found = {**staging_violations(staging), **written_violations(staging, fact, ranges)}
    grain = check_grain(ledger.fact).select(F.lit("grain").alias("check"), (F.col("total_rows") - F.col("distinct_keys")).alias("violations"))
    dims = dimension_constraints(ledger.dim_date, ledger.dim_type, ledger.accounts, ledger.fee_model, ledger.duplicate_legs)
    for d in dims:
        grain = grain.unionByName(_as_rows(d.toDF(*[f"constraint:{c}" for c in d.columns]), "check"))
    found |= {r["check"]: r["violations"] for r in grain.collect()}
    raise_violations(found)
    return found


def _raise_failures(report: DataFrame) -> DataFrame:
    """Collect the (small, fixed-size) report and raise on any FAIL."""
    failed = [r for r in report.collect() if r["result"] != "PASS"]
    if failed:
        raise ValidationError("; ".join(f"{r['check']}: {r['violations']} violation(s)" for r in failed))
    return report


def validate_staging(ledger) -> DataFrame:
    """Before any star table is built."""
    return _raise_failures(staging_report(ledger))


def validate(ledger) -> DataFrame:
    """All checks, on the written star."""
    return _raise_failures(validation_report(ledger))
