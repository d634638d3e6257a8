"""Declared schemas and the fixed values the model rests on.

Nothing is inferred: staging has a fixed 11-column contract, money is
DECIMAL(18,2), and the type dimension, fee assumptions, amount bands and
caveat topics are fixed values of the model.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Staging contract: one row per transaction, every column NOT NULL.
STAGING_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("amount", MONEY, False),
        T.StructField("name_orig", T.StringType(), False),
        T.StructField("oldbalance_org", MONEY, False),
        T.StructField("newbalance_orig", MONEY, False),
        T.StructField("name_dest", T.StringType(), False),
        T.StructField("oldbalance_dest", MONEY, False),
        T.StructField("newbalance_dest", MONEY, False),
        T.StructField("is_fraud", T.ShortType(), False),
        T.StructField("is_flagged_fraud", T.ShortType(), False),
    ]
)

# CSV header names of the source file, in column order.
CSV_HEADER = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]

STAGING_COLUMNS = [f.name for f in STAGING_SCHEMA.fields]

# Order that makes transaction_key deterministic: the published order
# (step, name_orig, amount) extended by every remaining staging column so
# that ties between non-identical rows cannot be broken arbitrarily.
FACT_KEY_ORDER = [
    "step", "name_orig", "amount", "type", "oldbalance_org", "newbalance_orig",
    "name_dest", "oldbalance_dest", "newbalance_dest", "is_fraud", "is_flagged_fraud",
]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference model for equal results).
# ---------------------------------------------------------------------------

# Transaction types: (key, name, description, is_fraud_bearing,
# orig_balance_sign, dest_balance_sign). +1 credited, -1 debited,
# None = balance not tracked.
TRANSACTION_TYPES = [
    (1, "CASH_IN", "Customer deposits cash into their account via a merchant.", False, 1, -1),
    (2, "CASH_OUT", "Customer withdraws cash from their account via a merchant.", True, -1, 1),
    (3, "DEBIT", "Funds moved from a mobile-money account to a bank account.", False, -1, 1),
    (4, "PAYMENT", "Customer pays a merchant for goods or services.", False, -1, None),
    (5, "TRANSFER", "Funds sent from one customer account to another.", True, -1, 1),
]

# Fee assumptions per type: (type_name, fee_rate, fee_min, fee_max, cost_per_txn, rationale).
# The figures are fixed values; the rationales are this project's own words.
FEE_ASSUMPTIONS = [
    ("CASH_IN", Decimal("0.00000"), Decimal("0.00"), Decimal("0.00"), Decimal("3.00"),
     "No charge: money paid in is what later fees are earned on."),
    ("CASH_OUT", Decimal("0.01500"), Decimal("10.00"), Decimal("5000.00"), Decimal("3.00"),
     "Charged most, as agents hand out notes and the balance leaves the system."),
    ("TRANSFER", Decimal("0.01000"), Decimal("10.00"), Decimal("10000.00"), Decimal("1.00"),
     "A booking between two accounts costs little; the cap bounds very large sums."),
    ("PAYMENT", Decimal("0.00500"), Decimal("1.00"), Decimal("1000.00"), Decimal("0.50"),
     "Shops pay it, and a small share keeps them taking part."),
    ("DEBIT", Decimal("0.00750"), Decimal("5.00"), Decimal("2000.00"), Decimal("1.00"),
     "Clearing with a bank has to be paid for, unlike a booking in house."),
]

# Amount bands: half-open [lower, next lower); the last band is unbounded
# and includes its lower edge (exactly 10M falls in band 6).
BAND_LOWER_EDGES = [0, 10_000, 100_000, 500_000, 1_000_000, 10_000_000]
BAND_LABELS = [
    (1, "1. under 10K"),
    (2, "2. 10K - 100K"),
    (3, "3. 100K - 500K"),
    (4, "4. 500K - 1M"),
    (5, "5. 1M - 10M"),
    (6, "6. 10M and over"),
]

# Fraud attribution buckets, in the order they are published.
ATTRIBUTION_BUCKETS = [
    ("TRANSFER", "First leg of theft: money taken from the victim account"),
    ("CASH_OUT", "Independent theft: fraudulent cash-out with no matching transfer"),
    ("NOT COUNTED (duplicate leg)",
     "Second leg of a theft already attributed to TRANSFER -- not new money"),
]
NOT_COUNTED = "NOT COUNTED (duplicate leg)"

# Synthetic calendar anchor: simulated day 0 (a Monday).
CALENDAR_ANCHOR = "2024-01-01"

# Ledger tolerance for "inconsistent" residuals.
RESIDUAL_TOLERANCE = Decimal("0.01")

# Types whose legs form the two-step theft signature: (first leg, second leg).
FIRST_LEG_TYPE = "TRANSFER"
SECOND_LEG_TYPE = "CASH_OUT"

# Fraud waterfall bars: (sort order, step label, bar type).
WATERFALL_STEPS = [
    (1, "Naive SUM(amount) WHERE is_fraud", "total"),
    (2, "Less: duplicate CASH_OUT leg of the same theft", "decrease"),
    (3, "True fraud loss", "total"),
]

# Caveats shipped with the marts: (id, topic, template). Every {name} is a
# figure computed from the data (see operators.dashboard.caveat_figures).
CAVEATS = [
    (1, "Fraud loss",
     "Each stolen sum counts once: {true_loss_m}M. Adding up every row marked as fraud would give {naive_loss_m}M, "
     "since a sum that is first moved by TRANSFER and then withdrawn by CASH_OUT stands in two rows."),
    (2, "Dates",
     "The source counts hours only (steps {min_step} to {max_step}, {days} days). Calendar dates are made up for "
     "display: day 0 is put on 2024-01-01."),
    (3, "Final day", "Day {last_day} holds {last_day_hours} of 24 hours. {final_day_note}"),
    (4, "Retention",
     "{pct_single}% of originators have one transaction and {pct_multi}% have several days, so figures on "
     "returning customers would say little and are left out."),
    (5, "Balance signature",
     "The originator's balances disagree with the amount in {fraud_bad}% of fraud rows and in {legit_bad}% of the "
     "others. This comes from how the data was made, so no detection rule should rest on it."),
    (6, "The 10M cash-outs",
     "Rows of exactly 10,000,000.00: {cashout_10m} of type CASH_OUT, {cashout_10m_fraud} of them fraud, and "
     "{transfer_10m_legit} of type TRANSFER that are not fraud."),
    (7, "Fee model",
     "The source has no fees. Revenue and cost follow assumed rates (table fee_model): compare segments with each "
     "other and take no amount as income that was earned."),
    (8, "Total value",
     "{total_bn}bn is the sum of all amounts moved. Money that moves twice is in it twice, fraud or not."),
    (9, "Zero-amount rows",
     "{zero_rows} fraud rows of type CASH_OUT move nothing. They stay, and the least fee charges {zero_fee} on them."),
]
FINAL_DAY_PARTIAL = "Its sums are lower for that reason alone; is_complete_day filters it out."
FINAL_DAY_COMPLETE = "It can be compared with the other days."
