"""SQL oracles of the marts and BI measures.

One wide aggregate (``TOTALS``) over the priced rows serves every grain: a mart
is that aggregate grouped by its keys, with published figures computed from the
sums. Nothing here shares text or steps with the DataFrame code."""

from __future__ import annotations

import re

from ledgerlens.plans.oracle_base import C2F, cents_to_double, mil, pct, rhu
from ledgerlens.schemas import (
    ATTRIBUTION_BUCKETS,
    BAND_LABELS,
    CAVEATS,
    FINAL_DAY_COMPLETE,
    FINAL_DAY_PARTIAL,
    TRANSACTION_TYPES,
    WATERFALL_STEPS,
)

TOTALS = """COUNT(*) AS n, SUM(cents) AS c, SUM(fee_u) AS fee_u, SUM(cost_c) AS cost_c, SUM(lost_c) AS lost_c,
    SUM(CASE WHEN type_name IN ('TRANSFER', 'CASH_OUT') THEN lost_c ELSE 0 END) AS true_c,
    countif(is_fraud)::BIGINT AS fraud_n, SUM(CASE WHEN is_fraud THEN cents ELSE 0 END) AS fraud_c,
    countif(is_flagged_fraud)::BIGINT AS flag_n, countif(is_fraud AND is_flagged_fraud)::BIGINT AS hit_n,
    SUM(CASE WHEN is_fraud AND NOT is_flagged_fraud THEN cents ELSE 0 END) AS missed_c,
    countif(hits_cap)::BIGINT AS cap_n, countif(hits_floor)::BIGINT AS floor_n, COUNT(DISTINCT date_key) AS hours,
    COUNT(DISTINCT name_orig) AS origins, COUNT(DISTINCT name_dest) AS targets"""

BAND = "CASE band_id " + " ".join(f"WHEN {i} THEN '{label}'" for i, label in BAND_LABELS) + " END"
COST = f"cost_c * {C2F}"


def net(fee: str, loss: str = "true_c") -> str:
    return f"{fee} - {COST} - {loss} * {C2F}"


def by(keys: str, where: str = "TRUE") -> str:
    """TOTALS of priced rows by ``keys`` (empty: of all rows) as a subquery."""
    return f"(SELECT {keys + ', ' if keys else ''}{TOTALS} FROM priced WHERE {where}{' GROUP BY ALL' if keys else ''})"


def profit(loss: str) -> str:
    return f"""{mil('fee_u', 7)} AS fee_revenue_millions, {mil('cost_c')} AS processing_cost_millions,
       {mil('fee_u - ' + COST, 7)} AS gross_profit_millions, {mil(loss)} AS fraud_loss_millions,
       {mil(net('fee_u', loss), 7)} AS net_profit_millions"""


DAY = "CAST(day_number AS BIGINT) AS day_number"
MARTS: dict[str, str] = {}

# ---- risk
_BUCKETS = ", ".join(f"({i}, '{name}', '{basis}')" for i, (name, basis) in enumerate(ATTRIBUTION_BUCKETS))
MARTS["fraud_loss_attribution"] = f"""
SELECT name AS attributed_to, basis, COUNT(cents) AS fraud_txns,
       {cents_to_double('SUM(cents)')} AS attributed_loss, {mil('SUM(cents)')} AS attributed_loss_millions,
       i < 2 AS counts_toward_true_loss
FROM (VALUES {_BUCKETS}) AS bucket(i, name, basis)
LEFT JOIN fact ON is_fraud AND i = CASE WHEN is_dup THEN 2 WHEN type_name = 'TRANSFER' THEN 0 WHEN type_name = 'CASH_OUT' THEN 1 END
GROUP BY i, name, basis
"""
MARTS["risk_fraud_by_type"] = f"""
SELECT type_name, is_fraud_bearing, n AS total_txns, fraud_n AS fraud_txns, {pct('fraud_n', 'n', 4)} AS fraud_rate_pct,
       {mil('fraud_c')} AS gross_fraud_value_millions, {pct('fraud_c', 'c', 4)} AS fraud_pct_of_type_value,
       {rhu('fraud_c', 'fraud_n * 100', 2)} AS avg_fraud_amount, flag_n AS flagged_txns, hit_n AS flagged_and_fraud,
       {pct('hit_n', 'fraud_n', 4)} AS incumbent_rule_recall_pct
FROM {by('type_name, is_fraud_bearing')}
"""
MARTS["risk_fraud_by_amount_band"] = f"""
SELECT amount_band, n AS total_txns, fraud_n AS fraud_txns, {pct('fraud_n', 'n', 4)} AS fraud_rate_pct,
       {mil('fraud_c')} AS gross_fraud_value_millions,
       {pct('fraud_c', '(SELECT SUM(cents) FROM fact WHERE is_fraud)', 2)} AS pct_of_all_fraud_value
FROM {by(BAND + ' AS amount_band')}
"""
MARTS["risk_flagged_vs_actual"] = f"""
SELECT hit_n AS true_positives, flag_n - hit_n AS false_positives, fraud_n - hit_n AS false_negatives,
       n - fraud_n - flag_n + hit_n AS true_negatives, {pct('hit_n', 'flag_n', 2)} AS precision_pct,
       {pct('hit_n', 'fraud_n', 4)} AS recall_pct, {mil('missed_c')} AS gross_value_missed_millions
FROM {by('')}
"""
MARTS["risk_balance_signature"] = f"""
SELECT type_name, is_fraud, n AS txns, o AS orig_inconsistent, {pct('o', 'n', 2)} AS pct_orig_inconsistent,
       dn AS dest_checkable_txns, d AS dest_inconsistent, {pct('d', 'dn', 2)} AS pct_dest_inconsistent
FROM (SELECT type_name, is_fraud, COUNT(*) AS n, COUNT(dest_balance_error) AS dn,
             COUNT(*) FILTER (WHERE orig_balance_error NOT BETWEEN -0.01 AND 0.01) AS o,
             COUNT(*) FILTER (WHERE dest_balance_error NOT BETWEEN -0.01 AND 0.01) AS d FROM fact GROUP BY ALL)
"""

# ---- growth
MARTS["growth_daily_activity"] = f"""
SELECT {DAY}, n AS txn_count, {cents_to_double('c')} AS total_value, {mil('c')} AS total_value_millions,
       origins AS active_originators, targets AS active_destinations, {rhu('c', 'n * 100', 2)} AS avg_txn_value,
       hours AS hours_observed, hours = 24 AS is_complete_day,
       {cents_to_double('c - lag(c) OVER (ORDER BY day_number)')} AS value_change_vs_prior_day
FROM {by('day_number')}
"""
MARTS["growth_daily_by_type"] = f"""
SELECT CAST(t.day_number AS BIGINT) AS day_number, type_name, t.n AS txn_count, {mil('t.c')} AS total_value_millions,
       {pct('t.n', 'd.n', 2)} AS pct_of_day_txns, {pct('t.c', 'd.c', 2)} AS pct_of_day_value
FROM {by('day_number, type_name')} AS t JOIN {by('day_number')} AS d ON t.day_number = d.day_number
"""
MARTS["growth_hourly_profile"] = f"""
SELECT CAST(hour_of_day AS BIGINT) AS hour_of_day, hours AS days_observed, {rhu('n', 'hours', 1)} AS avg_txns_per_hour,
       {rhu('c', 'hours * 100000000', 2)} AS avg_value_millions_per_hour, n AS total_txns,
       {pct('n', '(SELECT COUNT(*) FROM fact)', 2)} AS pct_of_all_txns, rank() OVER (ORDER BY n DESC) AS busiest_hour_rank
FROM {by('hour_of_day')}
"""
MARTS["growth_top_destinations"] = f"""
SELECT name_dest AS account_id, (SELECT party_type FROM acc WHERE account_id = name_dest) AS party_type,
       n AS txns_received, {mil('c')} AS value_received_millions, days AS active_days, fraud_n AS fraud_txns_received,
       {rhu('c', 'n * 100', 2)} AS avg_value_per_txn
FROM (SELECT name_dest, COUNT(*) AS n, SUM(cents) AS c, COUNT(DISTINCT day_number) AS days,
             CAST(countif(is_fraud) AS BIGINT) AS fraud_n FROM fact GROUP BY ALL ORDER BY c DESC, name_dest LIMIT 500)
"""
MARTS["growth_account_recurrence"] = f"""
SELECT role AS account_role, COUNT(*) AS distinct_accounts, CAST(countif(n = 1) AS BIGINT) AS single_txn_accounts,
       {pct('countif(n = 1)', 'COUNT(*)', 2)} AS pct_single_txn, CAST(countif(days > 1) AS BIGINT) AS multi_day_accounts,
       {pct('countif(days > 1)', 'COUNT(*)', 2)} AS pct_multi_day, MAX(n) AS max_txns, {rhu('SUM(n)', 'COUNT(*)', 3)} AS avg_txns
FROM (SELECT role, account, COUNT(*) AS n, COUNT(DISTINCT day_number) AS days
      FROM (SELECT day_number, unnest(['ORIGINATOR', 'DESTINATION']) AS role, unnest([name_orig, name_dest]) AS account FROM fact)
      GROUP BY ALL)
GROUP BY role
"""

# ---- profitability
_TYPE = f"""(SELECT type_name, n AS txn_count, {mil('c')} AS total_value_millions, {profit('true_c')},
       {rhu('fee_u', 'n * 10000000', 4)} AS avg_fee_per_txn, {pct('fee_u', f'c * {C2F}', 4)} AS effective_take_rate_pct,
       cap_n AS txns_hitting_cap, floor_n AS txns_hitting_floor, {pct('cap_n', 'n', 2)} AS pct_hitting_cap,
       {net('fee_u')} < 0 AS is_loss_making FROM {by('type_name')})"""
MARTS["profitability_by_type"] = f"SELECT * FROM {_TYPE}"
_TYPE_BAND = f"""(SELECT type_name, {BAND} AS amount_band, band_id, n AS txn_count, {mil('c')} AS total_value_millions, {profit('lost_c')},
       {pct('fee_u', f'c * {C2F}', 4)} AS effective_take_rate_pct, {net('fee_u', 'lost_c')} < 0 AS is_loss_making
       FROM {by('type_name, band_id')})"""
MARTS["profitability_by_type_and_band"] = f"SELECT * EXCLUDE (band_id, gross_profit_millions) FROM {_TYPE_BAND}"
_DAY = f"""(SELECT {DAY}, n AS txn_count, {profit('lost_c')}, hours = 24 AS is_complete_day,
       {mil(f"SUM({net('fee_u', 'lost_c')}) OVER (ORDER BY day_number)", 7)} AS cumulative_net_profit_millions FROM {by('day_number')})"""
MARTS["profitability_daily"] = f"SELECT * FROM {_DAY}"
_SUMMARY = f"""(SELECT n AS total_txns, {rhu('c', '100000000000', 2)} AS total_value_billions,
       {profit('true_c').replace('fraud_loss_millions', 'deduplicated_fraud_loss_millions')},
       {mil('fraud_c')} AS gross_fraud_loss_millions, {mil('fraud_c - true_c')} AS double_counted_millions,
       {pct('true_c', 'c', 4)} AS fraud_pct_of_total_value, {pct('fraud_n', 'n', 4)} AS fraud_pct_of_txn_count FROM {by('')})"""
MARTS["profitability_summary"] = f"SELECT * EXCLUDE (fraud_pct_of_txn_count) FROM {_SUMMARY}"

# ---- dashboard
_DATE = """(SELECT CAST(day_number AS BIGINT) AS day_number, CAST(d AS VARCHAR) AS simulated_date,
       concat('Day ', day_number) AS day_label, hours_observed, hours_observed = 24 AS is_complete_day,
       dayname(d) AS synthetic_weekday, CAST(day_number // 7 + 1 AS BIGINT) AS simulated_week
       FROM (SELECT day_number, COUNT(*) AS hours_observed, DATE '2024-01-01' + CAST(day_number AS INTEGER) AS d FROM dim_date GROUP BY ALL))"""
MARTS["dashboard_date"] = f"SELECT * FROM {_DATE}"
_KPI = f"""(SELECT * RENAME (deduplicated_fraud_loss_millions AS fraud_loss_millions, gross_fraud_loss_millions AS fraud_loss_naive_millions)
       FROM {_SUMMARY})"""
MARTS["dashboard_kpi"] = f"SELECT * FROM {_KPI}"
_DAILY = f"""(SELECT * EXCLUDE (total_value, hours_observed, value_change_vs_prior_day, is_complete_day)
       FROM ({MARTS["growth_daily_activity"]}) JOIN (SELECT * EXCLUDE (txn_count, is_complete_day) FROM {_DAY}) USING (day_number)
       JOIN (SELECT day_number, simulated_date, is_complete_day AS whole FROM {_DATE}) USING (day_number))"""
MARTS["dashboard_daily"] = f"SELECT * RENAME (whole AS is_complete_day) FROM {_DAILY}"
_BARS = {1: "fraud_c", 2: "lost_c - fraud_c", 3: "lost_c"}
MARTS["dashboard_fraud_waterfall"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS sort_order, '{step}' AS step, {mil(_BARS[i])} AS value_millions, '{kind}' AS bar_type FROM {by('')}"
    for i, step, kind in WATERFALL_STEPS
)

# ---- BI measures


def h(col: str) -> str:
    """A published 2-dp DOUBLE back to exact hundredths."""
    return f"CAST(round({col} * 100.0) AS HUGEINT)"


def total(col: str, source: str) -> str:
    return f"(SELECT {cents_to_double(f'SUM({h(col)})')} FROM {source})"


MARTS["measure_cards"] = f"""
SELECT total_txns AS total_transactions, total_value_billions, fee_revenue_millions, gross_profit_millions, net_profit_millions,
       fraud_loss_millions, fraud_loss_naive_millions, fraud_pct_of_total_value AS fraud_pct_of_value,
       fraud_pct_of_txn_count AS fraud_pct_of_count,
       (SELECT CAST(SUM(txn_count) AS BIGINT) FROM {_DAILY}) AS daily_transactions,
       (SELECT CAST(SUM(active_originators) AS BIGINT) FROM {_DAILY}) AS active_originators,
       {total('total_value_millions', _DAILY)} AS daily_value_millions,
       {total('cumulative_net_profit_millions', _DAILY)} AS cumulative_net_profit_millions,
       fraud_n AS fraud_transactions, fraud_n - hit_n AS frauds_missed, {mil('missed_c')} AS value_missed_millions,
       {total('net_profit_millions', _TYPE)} AS net_profit_by_type_millions,
       {total('fee_revenue_millions', _TYPE)} AS fee_revenue_by_type_millions,
       {total('fraud_loss_millions', _TYPE)} AS fraud_loss_by_type_millions,
       {total('net_profit_millions', _TYPE_BAND)} AS net_profit_band_millions
FROM {_KPI}, {by('')}
"""
MARTS["measure_fraud_pct_gross_profit"] = f"SELECT {rhu(h('fraud_loss_millions'), h('gross_profit_millions'), 4)} AS fraud_as_share_of_gross_profit FROM {_KPI}"
MARTS["measure_daily_value_complete"] = f"""
SELECT {cents_to_double(f"SUM({h('total_value_millions')})")} AS daily_value_complete_days_millions FROM {_DAILY} WHERE whole"""
MARTS["measure_value_7d_avg"] = f"""
SELECT d.day_number, d.simulated_date, (SELECT {rhu(f"SUM({h('v.total_value_millions')})", 'COUNT(*) * 100', 4)} FROM {_DAILY} AS v
       WHERE v.day_number BETWEEN d.day_number - 6 AND d.day_number) AS value_7d_avg_millions
FROM {_DATE} AS d"""
MARTS["measure_fraud_rate"] = f"SELECT {pct('fraud_n', 'n', 4)} AS fraud_rate_pct FROM {by('')}"
MARTS["measure_rule_recall"] = f"""
SELECT {pct('hit_n', 'fraud_n', 4)} AS incumbent_rule_recall_pct, fraud_n - hit_n AS frauds_missed,
       {mil('missed_c')} AS value_missed_millions FROM {by('')}"""
MARTS["measure_take_rate"] = f"""
SELECT {pct(f"SUM({h('fee_revenue_millions')})", f"SUM({h('total_value_millions')})", 4)} AS effective_take_rate_pct FROM {_TYPE}"""
MARTS["measure_is_loss_making"] = f"""
SELECT type_name, net_profit_millions, CAST(net_profit_millions < 0 AS BIGINT) AS is_loss_making FROM {_TYPE}"""
_HEAT = ", ".join(
    f"{cents_to_double(f'SUM({h("net_profit_millions")}) FILTER (WHERE band_id = {i})')} AS band_{i}" for i, _ in BAND_LABELS
)
MARTS["profit_heatmap"] = f"SELECT type_name, {_HEAT} FROM {_TYPE_BAND} GROUP BY type_name"
_MIX = ", ".join(f"CAST(nullif(countif(type_name = '{t[1]}'), 0) AS BIGINT) AS {t[1]}" for t in TRANSACTION_TYPES)
MARTS["product_mix"] = f"SELECT {DAY}, {_MIX} FROM fact GROUP BY day_number"

# ---- caveats: each template's figures as SQL


def _two(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(24,2)) AS VARCHAR)"


def _whole(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


_ZERO = "amount = 0 AND is_fraud AND type_name = 'CASH_OUT'"
_ORIGINS = "(SELECT COUNT(*) AS n, COUNT(DISTINCT day_number) AS days FROM fact GROUP BY name_orig)"


def _share(condition: str, among: str) -> str:
    return f"(SELECT {pct(f'countif({condition})', 'COUNT(*)', 2)} FROM fact WHERE {among})"


FIGURES = {
    "true_loss_m": _two(f"(SELECT deduplicated_fraud_loss_millions FROM {_SUMMARY})"),
    "naive_loss_m": _two(f"(SELECT gross_fraud_loss_millions FROM {_SUMMARY})"),
    "total_bn": _two(f"(SELECT total_value_billions FROM {_SUMMARY})"),
    "min_step": _whole("(SELECT MIN(date_key) FROM dim_date)"),
    "max_step": _whole("(SELECT MAX(date_key) FROM dim_date)"),
    "days": _whole("(SELECT MAX(day_number) + 1 FROM dim_date)"),
    "last_day": _whole("(SELECT MAX(day_number) FROM dim_date)"),
    "last_day_hours": _whole("(SELECT COUNT(*) FROM dim_date WHERE day_number = (SELECT MAX(day_number) FROM dim_date))"),
    "final_day_note": f"""CASE WHEN (SELECT COUNT(*) FROM dim_date WHERE day_number = (SELECT MAX(day_number) FROM dim_date)) < 24
        THEN '{FINAL_DAY_PARTIAL}' ELSE '{FINAL_DAY_COMPLETE}' END""",
    "pct_single": _two(f"(SELECT {pct('countif(n = 1)', 'COUNT(*)', 2)} FROM {_ORIGINS})"),
    "pct_multi": _two(f"(SELECT {pct('countif(days > 1)', 'COUNT(*)', 2)} FROM {_ORIGINS})"),
    "fraud_bad": _two(_share("abs(orig_balance_error) > 0.01", "is_fraud")),
    "legit_bad": _two(_share("abs(orig_balance_error) > 0.01", "NOT is_fraud")),
    "cashout_10m": _whole("(SELECT COUNT(*) FROM fact WHERE amount = 10000000 AND type_name = 'CASH_OUT')"),
    "cashout_10m_fraud": _whole("(SELECT COUNT(*) FROM fact WHERE amount = 10000000 AND type_name = 'CASH_OUT' AND is_fraud)"),
    "transfer_10m_legit": _whole("(SELECT COUNT(*) FROM fact WHERE amount = 10000000 AND type_name = 'TRANSFER' AND NOT is_fraud)"),
    "zero_rows": _whole(f"(SELECT COUNT(*) FROM fact WHERE {_ZERO})"),
    "zero_fee": _two(f"(SELECT CAST(COALESCE(SUM(fee_u), 0) AS DECIMAL(38,0)) / 10000000 FROM priced WHERE {_ZERO})"),
}


def _caveat(number: int, topic: str, template: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pieces = [FIGURES[p] if i % 2 else quoted(p) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return f"SELECT CAST({number} AS BIGINT) AS caveat_id, {quoted(topic)} AS applies_to, concat({', '.join(pieces)}) AS caveat_text"


MARTS["dashboard_data_caveats"] = " UNION ALL ".join(_caveat(*c) for c in CAVEATS)
