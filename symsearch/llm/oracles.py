"""DuckDB SQL that says the same as some of the queries."""

from __future__ import annotations

from symsearch.llm import host_rules, sharding

# Words are runs of digits, a-z and non-ASCII characters of the lower-cased text; items of fewer than 13 are one window.
OP1 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
item as (select item_id, w, least(13, len(w)) as size from b where len(w) > 0),
win as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as s from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as i from item)),
place as (select doc_id, w, size, i, array_to_string(w[i:i + size - 1], ' ') as s from (select d.doc_id, d.w, z.size, unnest(range(1, len(d.w) - z.size + 2)) as i from d, (select distinct size from win) z where len(d.w) >= z.size)),
occ as (select place.doc_id, place.i, place.size, win.item_id from place join win on place.size = win.size and place.s = win.s),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from occ)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

# The MEASURES of each text, and what its host's verdict makes of them.
OP10 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as k from g) where k > 1) group by doc_id),
m as (select d.doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 cast(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as bigint) as n_lines,
 cast(len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_kinds, coalesce(rep.n, 0) as n_repeat_words
 from d left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 10 * n_symbols > n_words or 2 * (n_lines - n_kinds) > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as rule_failed from m),
h as (select source, count(*) as n, cast(sum(case when base_failed or rule_failed then 1 else 0 end) as double) as k from f where source is not null group by source),
mom as (select sum(k) / sum(n) as mean, sum(k * k / n) / sum(n) as sq, count(*) as hosts, sum(n) as docs from h),
var as (select mean, mean * (1 - mean) as within, sq - mean * mean - (hosts - 1) * mean * (1 - mean) / docs as between_ from mom),
prior as (select mean, case when between_ > within / {host_rules.MOST_PRIOR} then least({host_rules.MOST_PRIOR}, greatest(1.0, within / between_ - 1)) else {host_rules.MOST_PRIOR} end as strength from var),
v as (select source, (k + mean * strength) / (n + strength) as rate from h, prior)
select f.doc_id, n_words, word_chars, n_symbols, n_lines - n_kinds as n_dup_lines, n_repeat_words, base_failed,
 not base_failed and coalesce(rate, 0.5) < {host_rules.BAD_RATE} and (coalesce(rate, 0.5) < {host_rules.TRUSTED_RATE} or not rule_failed) as kept,
 case when coalesce(rate, 0.5) >= {host_rules.BAD_RATE} then 'bad' when coalesce(rate, 0.5) < {host_rules.TRUSTED_RATE} then 'trusted' else 'normal' end as verdict
from f left join v using (source)
"""


def op9() -> str:
    """The table is built once more; hashing, and the look-up, are SQL's own."""
    owners = ",".join(map(str, sharding.lookup_table(sharding.SHARDS, sharding.SLOTS)))
    return f"""
with t as (select string_split('{owners}', ',') as o),
p as (select doc_id, cast(octet_length(encode(text)) as integer) as n_bytes, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {sharding.SLOTS} as bigint) as slot from documents)
select doc_id, n_bytes, slot, 'shard-' || lpad(o[slot + 1], 3, '0') as shard from p, t
"""
