"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

from tallyframe.llm import rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select rid, doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
grams as (select rid, coalesce(doc_id, 9223372036854775807) as id, p, md5(array_to_string(w[p : p + 19], ' ')) as g
  from (select rid, doc_id, w, unnest(range(1, len(w) - 18)) as p from d where len(w) >= 20) t),
firsts as (select g, min(row(id, p)) as place from grams group by g),
later as (select rid, p from grams join firsts using (g) where row(id, p) > place),
gone as (select distinct rid, p + k as p from later, (select unnest(range(20)) as k) o),
kept as (select words.rid, count(gone.p) as n_removed, string_agg(case when gone.p is null then word end, ' ' order by words.p) as t
  from words left join gone on gone.rid = words.rid and gone.p = words.p group by words.rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (rid)"""

_ITEM_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""
with d as (select row_number() over () as rid, doc_id, {_ITEM_WORDS} as w from documents),
b as (select item_id, {_ITEM_WORDS} as w from benchmark),
grams as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0) t),
seen as (select rid, p, n, array_to_string(w[p : p + n - 1], ' ') as g from (select rid, w, unnest(range(1, len(w) + 1)) as p from d) t,
  (select distinct n from grams) s where p + n - 1 <= len(w)),
hits as (select rid, p, grams.n, item_id from seen join grams on seen.g = grams.g and seen.n = grams.n),
covered as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from hits) t group by rid),
items as (select rid, count(item_id) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct rid, cast(item_id as varchar) as item_id from hits) t group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated from d left join covered using (rid) left join items using (rid)"""


_TERMS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH = rf"""
with d as (select row_number() over () as rid, doc_id, {_TERMS} as t from documents),
n as (select count(*)::bigint as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
tf as (select rid, term, count(*) as tf from (select rid, unnest(t) as term from d) x group by rid, term),
df as (select term, count(*) as df from tf group by term),
q as (select row_number() over () as qid, item_id, text from (select distinct item_id, text from benchmark) x),
w as (select qid, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select distinct qid, term from (select qid, unnest({_TERMS}) as term from q) x) y join df using (term), n),
s as (select qid, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n_docs) // n_terms))))::bigint as score
  from w join tf using (term) join d using (rid), n group by qid, rid),
r as (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id nulls last)::int as rank from s join d using (rid) where score > 0)
select item_id, rank, doc_id, score from r join q using (qid) where rank <= 10"""


def _rules() -> str:
    grid = ", ".join(f"('{r}', {c!r}::double)" for r, cuts in rules.GRID.items() for c in cuts)
    values = " ".join(f"when '{r}' then {r}" for r in rules.GRID)
    risk = rules.RISK / len(rules.GRID)
    order = " ".join(f"when '{r}' then {i}" for i, r in enumerate(rules.GRID))
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select rid, unnest(string_split(t, chr(10))) as l from d),
per_line as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
grams as (select rid, p, md5(array_to_string(w[p : p + 2], ' ')) as g from (select rid, w, unnest(range(1, len(w) - 1)) as p from d where len(w) >= 3) t),
twice as (select rid, p from (select *, count(*) over (partition by rid, g) as n from grams) t where n > 1),
repeats as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + 3)) as q from twice) t group by rid),
m as (select d.rid, doc_id, lang, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
  from d left join per_line using (rid) left join repeats using (rid)),
f as (select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
    case when word_chars > 0 then n_symbols / word_chars else 0 end as symbol_share, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_share,
    case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_share, case when n_words > 0 then word_chars / n_words else 0 end as word_length,
    case when n_words > 0 then 1 / n_words else 1 end as shortness from m),
grid(rule, cutoff) as (values {grid}),
long as (select rid, lang, base_failed, doc_id, rule, cutoff, case rule {values} end >= cutoff as out from f, grid),
known as (select doc_id, min(quality) = 1 as clean from labels where doc_id is not null group by doc_id having min(quality) = 0 or (min(quality) = 1 and max(coalesce(toxic, 0)) = 0)),
tests as (select lang, rule, cutoff, count(*) filter (clean) as n, count(*) filter (clean and out) as k, count(*) filter (not clean and out) as caught
  from long join known using (doc_id) where not base_failed group by lang, rule, cutoff),
tails as (select *, case when k > n * {risk!r} then 1 else list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) end as p from tests),
chains as (select greatest(count(*), 1) as m from (select distinct lang, rule from tests) t),
steps as (select *, max(case when n > 0 and p <= {rules.DELTA!r} / (select m from chains) then 0 else 1 end)
  over (partition by lang, rule order by cutoff desc rows between unbounded preceding and current row) as failed from tails),
safe as (select *, row_number() over (partition by lang, rule order by caught desc, cutoff desc) as r from steps where failed = 0 and caught > 0),
broken as (select rid, string_agg(l.rule, ',' order by case l.rule {order} end) as rejected_by from long l join safe s on l.lang is not distinct from s.lang and l.rule = s.rule and l.cutoff = s.cutoff
  where s.r = 1 and out group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from f left join broken using (rid)"""


ORACLE = {"op4_quality_rules": _rules(), "op8_substrings": SUBSTRINGS, "op9_decontamination": DECONTAMINATION, "op12_ranked_search": SEARCH}
