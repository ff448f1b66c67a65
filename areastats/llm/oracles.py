"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .line_dedup import LEAST_CHARS
from .quality import RULES, STOP_WORDS

SPACE_WORD = r"[^\x20\x09-\x0D]+"

_FORMS = ", ".join(f"'{form}'" for word in STOP_WORDS for form in dict.fromkeys((word, word.capitalize())))


def _symbols(chars: str) -> str:
    return " + ".join(f"(strlen(t) - strlen(replace(t, '{c}', '')))" for c in chars)


def _verdict() -> str:
    tests = []
    for rule in RULES:
        top, bottom = rule.measure.split(" / ")
        ratio = f"({top}::double / nullif({bottom}, 0))"
        tests += [f"coalesce({ratio} >= {rule.least}, true)"] if rule.least is not None else []
        tests += [f"coalesce({ratio} <= {rule.most}, true)"] if rule.most is not None else []
    return " and ".join(tests)


QUALITY = rf"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (
  select r, doc_id, t, regexp_extract_all(t, '{SPACE_WORD}') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) as l
  from texts),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from split),
windows as (
  select r, i, word, lead(word, 1) over v as second, lead(word, 2) over v as third
  from words window v as (partition by r order by i)),
twice as (
  select r, i from (
    select r, i, count(*) over (partition by r, word, second, third) as n from windows where third is not null)
  where n > 1),
repeated as (
  select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
counted as (
  select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
         {_symbols('#*$%&|<>')} as n_symbols, {_symbols('!?')} as n_shouts,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
         len(list_filter(w, lambda x: x in ({_FORMS}))) as n_stop_words,
         coalesce(n, 0) as n_repeat_words
  from split left join repeated using (r)),
base as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_verdict()} as kept
from base
"""


def jaccard(length: int, percent: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(length))
    return rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE_WORD}') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {length} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {length - 2}), lambda i: {joined}) end) as s
  from words),
classes as (
  select min(doc_id) as rep, len(s) as n, s
  from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s),
items as (select rep, n, unnest(s) as item from classes),
links as (
  select a.rep as a, b.rep as b
  from items a join items b on a.item = b.item and a.rep < b.rep
    and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
ends as (select a, b from links union all select b, a from links),
reached as (
  select rep as node, rep as other from classes
  union
  select r.node, t.b from reached r join ends t on r.other = t.a),
placed as (select node, min(other) as component from reached group by node)
select s.doc_id, len(s.s) as n_shingles, coalesce(p.component, s.doc_id) as component_id
from sets s
left join classes c on list_sort(s.s) = c.s and len(s.s) > 0
left join placed p on p.node = c.rep
"""


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = rf"""
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}') as w
  from documents),
bench as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as span
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from bench where len(w) > 0)),
sizes as (select distinct size from windows),
starts as (
  select r, size, i, array_to_string(w[i : i + size - 1], ' ') as span
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
found as (select r, i, size, item_id from starts join windows using (size, span)),
hit as (
  select r, count(distinct spot) as n_hit from (select r, unnest(range(i, i + size)) as spot from found) group by r),
items as (
  select r, count(distinct item_id) as n_items, list_sort(list_distinct(list(item_id::varchar))) as ids from found group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(array_to_string(coalesce(ids, []), ',')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (r) left join items using (r)
"""

LINE_DEDUP = rf"""
with pieces as (select doc_id, string_split(text, chr(10)) as l from documents),
all_lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from pieces),
lines as (
  select doc_id, i, line, doc_id * 1000000 + i as place from all_lines where regexp_matches(line, '{SPACE_WORD}')),
firsts as (select line, min(place) as first, length(line) as n from lines group by line),
halves as (
  select line, first, unnest([
    ('a', n, left(line, n // 2)), ('b', n, right(line, n // 2)),
    ('a', n - 1, left(line, (n - 1) // 2)), ('b', n - 1, right(line, (n - 1) // 2))]) as half
  from firsts where n >= {LEAST_CHARS}),
near as (
  select b.line, min(a.first) as near
  from halves a join halves b on a.half = b.half and a.first < b.first
  where levenshtein(a.line, b.line) = 1 group by b.line),
judged as (
  select doc_id, i, line, first < place as equal, first = place and coalesce(near, place) < place as near
  from lines join firsts using (line) left join near using (line)),
counts as (
  select doc_id, count(*) as n_lines, count(*) filter (equal) as n_equal, count(*) filter (near) as n_near
  from judged group by doc_id),
kept as (
  select a.doc_id, string_agg(a.line, chr(10) order by a.i) as text
  from all_lines a left join judged j on a.doc_id = j.doc_id and a.i = j.i and (j.equal or j.near)
  where j.doc_id is null group by a.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_equal, 0) as n_equal, coalesce(n_near, 0) as n_near,
       case when d.text is not null then md5(coalesce(k.text, '')) end as text_md5
from documents d left join counts using (doc_id) left join kept k using (doc_id)
"""

ORACLES = {
    "op3_line_dedup": LINE_DEDUP,
    "op6_quality_rules": QUALITY,
    "op9_ngram_jaccard_join": jaccard(3, 90),
    "op10_benchmark_decontamination": CONTAMINATION,
}
