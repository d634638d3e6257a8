"""DuckDB SQL for the operators that SQL can express, written from their
contracts and not from the Spark code."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
item_win as (
  select distinct item, least(13, len(w)) as k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)
),
sizes as (select distinct k from item_win),
doc_win as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') as win
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)
),
hits as (select r, i, k, item from doc_win join item_win using (k, win)),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join places using (r) left join items using (r)
"""

_OP3 = r"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select r, i, array_to_string(w[i : i + 7], ' ') as win from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, win) as c from wins) where c > 1),
repeats as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
lines as (select r, count(*) as n, count(*) - count(distinct line) as dup
  from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select d.r, doc_id, host, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_lines,
  coalesce(dup, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from d left join lines on lines.r = d.r left join repeats on repeats.r = d.r),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
g as (select *, base_failed or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines as rule_failed from f),
h as (select host, count(*)::double as n, sum(rule_failed::int)::double as k from g where host is not null group by host),
s as (select count(*) as hosts, sum(n) as n, sum(k) as k, sum(n * n) as n2, sum(k * k / n) as k2 from h),
v as (select *, k / n as share, (k + 0.5) / (n + 1) as mean from s),
rho as (select mean, greatest(1e-4, least(0.99, coalesce((k2 - n * share * share - (hosts - 1) * share * (1 - share))
  / nullif((n - n2 / n - (hosts - 1)) * share * (1 - share), 0), 0))) as rho from v),
prior as (select mean * (1 / rho - 1) as a, (1 - mean) * (1 / rho - 1) as b from rho)
select doc_id, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce((k + a) / (h.n + a + b), 0) <= 0.5 as kept,
  n_words, rule_failed, g.host, coalesce((k + a) / (h.n + a + b), a / (a + b)) as host_rate
from g cross join prior left join h on h.host = g.host
"""


def _draw(label: str, weight: float) -> str:
    return f"-ln((cast(('0x' || substr(md5(k || ':' || {label}), 1, 13)) as bigint) + 0.5) / 4503599627370496.0) / {weight}"


def _tree(regions: str, least: str) -> str:
    """Shard of each key under the regions (label, weight) given as SQL rows."""
    return f"""(select k, arg_min(shard, {_draw("'s' || shard", 1.0)}) as {least} from (
      select k, any_value(g) as g, arg_min(rack, {_draw("'g' || g || 'k' || rack", 1.0)}) as rack from (
        select k, arg_min(g, -ln((cast(('0x' || substr(md5(k || ':g' || g), 1, 13)) as bigint) + 0.5) / 4503599627370496.0) / wt) as g
        from keys, (values {regions}) as x(g, wt) group by k)
      join racks using (g) group by k)
    join shards using (g, rack) group by k)"""


#: Whole result; DuckDB has no crc32, so the test that compares it registers one.
SHARD_PLACEMENT = f"""
with rows_in as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, crc32(coalesce(text, '')) as crc,
  octet_length(encode(coalesce(text, '')))::bigint + 8 as size from documents),
keys as (select distinct k from rows_in),
shards as (select (s // 12) as g, (s // 4) % 3 as rack, s as shard from range(24) as x(s) union all select 2, 0, 24),
racks as (select distinct g, rack from shards),
now as {_tree("(0, 12.0), (1, 12.0)", "shard")},
grown as {_tree("(0, 12.0), (1, 12.0), (2, 1.0)", "grown_shard")}
select doc_id, size, crc as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by substr(md5(concat(k, ':', crc, ':', size)), 1, 3), doc_id nulls first, crc, size) - 1 as slot,
  grown_shard::int as grown_shard
from rows_in join now using (k) join grown using (k)
"""

ORACLE = {"op1_decontaminate": _OP1, "op3_host_rules": _OP3}
