"""Evidence queries: the figures behind the model's claims (leg pairing,
full drains, chain tracing, the uncapped-fee what-if, the 10M cluster,
zero amounts, naive vs direction-aware residuals, amount statistics, type
shares, fraud size ratio and the merchant rule).

Pairs are never materialised: pair counts are sums of products of
per-signature counts, so a signature shared by millions of rows costs one
aggregate row, not millions squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.fees import FEE_SCALE, uncapped_fee_sql
from ledgerlens.functions.numeric import ratio_half_up
from ledgerlens.operators.common import beside, cell_sums, fee_units_of_cents, millions, pct, sum_cents, with_type_names
from ledgerlens.operators.star import SIGNATURE
from ledgerlens.schemas import FIRST_LEG_TYPE, RESIDUAL_TOLERANCE, SECOND_LEG_TYPE

TEN_MILLION = 10_000_000
NEAR_CEILING = 9_900_000


def evidence_leg_pairs(ledger) -> DataFrame:
    fr = ledger.fraud_rows
    per_hour = lambda t, n: (
        fr.where(F.col("type_name") == t).groupBy(*SIGNATURE, "date_key").agg(F.count(F.lit(1)).alias(n))
    )
    t_h, c_h = per_hour(FIRST_LEG_TYPE, "nt"), per_hour(SECOND_LEG_TYPE, "nc")
    t_s = t_h.groupBy(*SIGNATURE).agg(F.sum("nt").alias("nt"))
    c_s = c_h.groupBy(*SIGNATURE).agg(F.sum("nc").alias("nc"))
    sig = t_s.join(c_s, SIGNATURE).agg(
        F.coalesce(F.sum(F.col("nt") * F.col("nc")), F.lit(0)).alias("leg_pairs"),
        F.count(F.lit(1)).alias("distinct_signatures"),
        F.coalesce(F.sum("nc"), F.lit(0)).alias("duplicate_legs"),
    )
    same = t_h.join(c_h, SIGNATURE + ["date_key"]).agg(
        F.coalesce(F.sum(F.col("nt") * F.col("nc")), F.lit(0)).alias("same_hour_pairs")
    )
    return beside(sig, same).select("leg_pairs", "distinct_signatures", "same_hour_pairs", "duplicate_legs")


def evidence_full_drain(ledger) -> DataFrame:
    t = ledger.fraud_rows.where(F.col("type_name") == FIRST_LEG_TYPE).agg(
        F.count(F.lit(1)).alias("fraud_transfers"),
        F.count_if(F.col("amount") == F.col("oldbalance_org")).alias("full_drain_transfers"),
    )
    return t.select(
        "fraud_transfers",
        "full_drain_transfers",
        pct("full_drain_transfers", "fraud_transfers", 2).alias("pct_full_drain"),
    )


def evidence_chain_trace(ledger) -> DataFrame:
    """Fraud cash-outs that originate from an account a fraud transfer paid into."""
    fr = ledger.fraud_rows
    landed = fr.where(F.col("type_name") == FIRST_LEG_TYPE).select(F.col("name_dest").alias("name_orig")).distinct()
    cash = fr.where(F.col("type_name") == SECOND_LEG_TYPE)
    chained = cash.join(landed, "name_orig", "left_semi").agg(F.count(F.lit(1)).alias("chained_cashouts"))
    return beside(cash.agg(F.count(F.lit(1)).alias("fraud_cashouts")), chained)


def what_if_uncapped_fee(ledger) -> DataFrame:
    nocap = f"CAST(({uncapped_fee_sql('amount', 'fee_rate', 'fee_min')}) * {10**FEE_SCALE} AS DECIMAL(30,0))"
    uncapped = ledger.priced.groupBy("transaction_type_key").agg(F.sum(F.expr(nocap)).alias("nocap_u"))
    agg = ledger.net_cells.groupBy("transaction_type_key").agg(*cell_sums()).join(uncapped, "transaction_type_key")
    rest = f"{fee_units_of_cents('cost_cents')} - {fee_units_of_cents('true_cents')}"
    return with_type_names(agg, ledger.dim_type).select(
        "type_name",
        "txn_count",
        millions("fee_u", FEE_SCALE).alias("fee_revenue_millions"),
        millions("nocap_u", FEE_SCALE).alias("uncapped_fee_revenue_millions"),
        millions(f"fee_u - {rest}", FEE_SCALE).alias("net_profit_millions"),
        millions(f"nocap_u - {rest}", FEE_SCALE).alias("uncapped_net_profit_millions"),
    ).orderBy("type_name")


def evidence_round_amount_cluster(ledger) -> DataFrame:
    a = F.col("amount")
    agg = ledger.facts.groupBy("transaction_type_key", "is_fraud").agg(
        F.count(F.lit(1)).alias("txns"),
        F.count_if(a == F.lit(TEN_MILLION)).alias("exact_10m_txns"),
        F.count_if((a == F.lit(TEN_MILLION)) & (F.col("oldbalance_org") == F.lit(TEN_MILLION))).alias(
            "exact_10m_opening_10m"
        ),
        F.count_if((a >= F.lit(NEAR_CEILING)) & (a < F.lit(TEN_MILLION))).alias("near_ceiling_txns"),
    )
    return with_type_names(agg, ledger.dim_type).select(
        "type_name", "is_fraud", "txns", "exact_10m_txns", "exact_10m_opening_10m", "near_ceiling_txns"
    ).orderBy("type_name", "is_fraud")


def evidence_zero_amount(ledger) -> DataFrame:
    agg = (
        ledger.priced.where(F.col("amount") == 0)
        .groupBy("transaction_type_key", "is_fraud")
        .agg(F.count(F.lit(1)).alias("zero_amount_txns"), F.sum("fee_u").alias("fee_u"))
    )
    return with_type_names(agg, ledger.dim_type).select(
        "type_name",
        "is_fraud",
        "zero_amount_txns",
        ratio_half_up("fee_u", 10 ** (FEE_SCALE - 2), 2).alias("fee_charged"),
    ).orderBy("type_name", "is_fraud")


def evidence_naive_residual(ledger) -> DataFrame:
    """One-sign residuals (always debit the originator, always credit the
    destination) against the direction-aware residuals of the model."""
    tol = F.lit(RESIDUAL_TOLERANCE)
    naive_o = F.col("newbalance_orig") - (F.col("oldbalance_org") - F.col("amount"))
    naive_d = F.col("newbalance_dest") - (F.col("oldbalance_dest") + F.col("amount"))
    agg = ledger.facts.groupBy("transaction_type_key").agg(
        F.count(F.lit(1)).alias("txns"),
        F.count_if(F.abs(naive_o) > tol).alias("naive_orig_inconsistent"),
        F.count_if(F.abs(F.col("orig_balance_error")) > tol).alias("aware_orig_inconsistent"),
        F.count_if(F.abs(naive_d) > tol).alias("naive_dest_inconsistent"),
        F.count_if(F.abs(F.col("dest_balance_error")) > tol).alias("aware_dest_inconsistent"),
    )
    return with_type_names(agg, ledger.dim_type).select(
        "type_name", "txns", "naive_orig_inconsistent", "aware_orig_inconsistent",
        "naive_dest_inconsistent", "aware_dest_inconsistent",
    ).orderBy("type_name")


FINE_BITS, STEP_BITS = 12, 4  # values under 2^12 have buckets of their own; buckets widen 2^4 times at a step
MEDIAN_BUCKETS = 1 << 16  # parts of a bucket that are counted at once


def bucket_width(size: int) -> int:
    """Width of the histogram's buckets for values of this absolute size."""
    width = 1
    while size >= width << FINE_BITS:
        width <<= STEP_BITS
    return width


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bucket, n): log-linear counts of integer ``value``. A bucket is named by
    its number nearest to zero; a key has at most 3,840 buckets for each 4 bits
    (both signs), whatever its values are, so tasks hand on bounded counts that
    add up."""
    size = f"abs({value})"
    steps = [1 << k for k in range(0, 62 - FINE_BITS, STEP_BITS)]
    cases = " ".join(f"WHEN {size} < {w << FINE_BITS}L THEN {w}L" for w in steps)
    bucket = F.expr(f"{value} - {value} % (CASE {cases} ELSE {steps[-1] << STEP_BITS}L END)").alias("bucket")
    return rows.where(F.col(value).isNotNull()).groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))


def interval_of(bucket: int) -> tuple[int, int]:
    """[lo, hi) of the values in a bucket."""
    width = bucket_width(abs(bucket))
    return (bucket - width + 1, bucket + 1) if bucket < 0 else (bucket, bucket + width)


def place(rank: int, counts: list[tuple[int, int]]) -> tuple[int, int]:
    """(bucket, rank inside it) of a rank among sorted (bucket, n)."""
    for bucket, n in counts:
        if rank < n:
            return bucket, rank
        rank -= n
    raise ValueError("rank beyond the counted rows")


def middle_values(rows: DataFrame, key: str, value: str) -> dict:
    """key -> (lower, upper) middle value of integer ``value``, exact; null values
    don't count, and a key without others is left out.

    Selection by counting: one histogram finds the buckets of the middle ranks,
    and one more pass counts the values inside them (two passes from 2^28 on,
    where a bucket holds over MEDIAN_BUCKETS numbers). Nothing is sorted or
    written. ``key`` has few values (it is a dimension)."""
    spark = rows.sparkSession
    counts: dict = {}
    for k, bucket, n in histogram(rows, key, value).collect():
        counts.setdefault(k, []).append((bucket, n))
    # [key, rank among the interval's rows, lo, hi): two a key
    wanted = []
    for k, found in counts.items():
        found.sort()
        total = sum(n for _, n in found)
        for middle in ((total - 1) // 2, total // 2):
            bucket, rank = place(middle, found)
            wanted.append([k, rank, *interval_of(bucket)])
    while any(hi - lo > 1 for _, _, lo, hi in wanted):
        open_ = [(k, lo, max(1, -(-(hi - lo) // MEDIAN_BUCKETS)), hi) for k, lo, hi in {(k, lo, hi) for k, _, lo, hi in wanted if hi - lo > 1}]
        intervals = F.broadcast(spark.createDataFrame(open_, f"{key} {dict(rows.dtypes)[key]}, lo long, width long, hi long"))
        parts: dict = {}
        for k, lo, part, n in (
            rows.join(intervals, key)
            .where(f"{value} >= lo AND {value} < hi")
            .groupBy(key, "lo", F.expr(f"({value} - lo) div width").alias("part"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        ):
            parts.setdefault((k, lo), []).append((part, n))
        widths = {(k, lo): width for k, lo, width, _ in open_}
        for w in wanted:
            k, rank, lo, hi = w
            if hi - lo > 1:
                part, w[1] = place(rank, sorted(parts[k, lo]))
                w[2:] = [lo + part * widths[k, lo], min(hi, lo + (part + 1) * widths[k, lo])]
    return {k: (low[2], high[2]) for (k, *_), low, high in zip(wanted[::2], wanted[::2], wanted[1::2])}


def evidence_amount_stats(ledger) -> DataFrame:
    """Mean, exact median and max amount per type."""
    base = ledger.facts.select("transaction_type_key", "amount", F.expr("CAST(amount * 100 AS BIGINT)").alias("cents"))
    stats = base.groupBy("transaction_type_key").agg(
        F.count(F.lit(1)).alias("txns"), sum_cents("amount").alias("value_cents"), F.max("amount").alias("max_amount")
    )
    middle = {k: a + b for k, (a, b) in middle_values(base, "transaction_type_key", "cents").items()}
    mid2 = F.create_map(*[F.lit(x) for kv in middle.items() for x in kv])[F.col("transaction_type_key")] if middle else F.lit(None).cast("long")
    return with_type_names(stats.withColumn("mid2", mid2), ledger.dim_type).select(
        "type_name",
        "txns",
        ratio_half_up("value_cents", "txns * 100", 2).alias("mean_amount"),
        ratio_half_up("mid2", 200, 2).alias("median_amount"),
        F.col("max_amount").cast("double").alias("max_amount"),
    ).orderBy("type_name")


def type_share(ledger) -> DataFrame:
    agg = ledger.facts.groupBy("transaction_type_key").agg(
        F.count(F.lit(1)).alias("txn_count"), sum_cents("amount").alias("value_cents")
    )
    return with_type_names(agg, ledger.dim_type).select(
        "type_name",
        "txn_count",
        pct("txn_count", "sum(txn_count) OVER ()", 2).alias("pct_of_txns"),  # five rows
        pct("value_cents", "sum(value_cents) OVER ()", 2).alias("pct_of_value"),
    ).orderBy("type_name")


def evidence_fraud_size_ratio(ledger) -> DataFrame:
    s = ledger.facts.agg(
        F.count(F.lit(1)).alias("n"),
        sum_cents("amount").alias("c"),
        F.count_if(F.col("is_fraud")).alias("fn"),
        sum_cents(F.when(F.col("is_fraud"), F.col("amount"))).alias("fc"),
    )
    return s.select(
        ratio_half_up("fc", "fn * 100", 2).alias("mean_fraud_amount"),
        ratio_half_up("c", "n * 100", 2).alias("mean_amount"),
        ratio_half_up("fc * n", "fn * c", 2).alias("fraud_size_ratio"),
    )


def evidence_merchant_payment(ledger) -> DataFrame:
    m = F.left(F.col("name_dest"), F.lit(1)) == "M"
    pay = F.col("type_name") == "PAYMENT"
    s = ledger.named_accounts(ledger.facts.select("type_name", "name_dest"), "name_dest").agg(
        F.count_if(pay).alias("payment_txns"),
        F.count_if(m).alias("merchant_dest_txns"),
        F.count_if(pay & m).alias("payment_to_merchant_txns"),
    )
    return s.withColumn(
        "rule_holds",
        (F.col("payment_txns") == F.col("merchant_dest_txns"))
        & (F.col("payment_txns") == F.col("payment_to_merchant_txns")),
    )
