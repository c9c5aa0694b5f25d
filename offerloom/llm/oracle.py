"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '{gap}'), lambda x: x <> '')"""
_SPACE = r"[\x20\x09-\x0D]+"
_PLAIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SHINGLES = f"""
with recursive word_lists as (
 select doc_id, {_LOWER_WORDS.format(gap=_SPACE)} as w from documents),
shingles as (
 select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ')
  else array_to_string(w[i:i+4], ' ') end as s
 from word_lists, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
 select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
 group by a.doc_id, b.doc_id),
links as (
 select x, y from common join sizes p on x = p.doc_id join sizes q on y = q.doc_id where 100 * c >= 80 * (p.n + q.n - c)),
reach as (
 select doc_id as x, doc_id as y from sizes union select r.x, l.y from reach r join links l on r.y = l.x)"""

JACCARD = f"""{_SHINGLES}
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id
from documents d left join sizes s using (doc_id)
left join (select x as doc_id, min(y) as component_id from reach group by x) m using (doc_id)"""

CONTAMINATION_CTES = f"""
doc_words as (select doc_id, {_LOWER_WORDS.format(gap=_PLAIN)} as w from {{documents}}),
item_words as (select item_id, {_LOWER_WORDS.format(gap=_PLAIN)} as w from benchmark),
windows as (
 select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i+least(len(w), 13)-1], ' ') as s
 from item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(i) where len(w) > 0),
window_sizes as (select distinct size from windows),
doc_windows as (
 select doc_id, i, size, array_to_string(w[i:i+size-1], ' ') as s
 from doc_words, window_sizes, unnest(range(1, len(w) - size + 2)) as t(i) where len(w) >= size),
met as (select doc_id, i, d.size, item_id from doc_windows d join windows v on d.size = v.size and d.s = v.s),
hit as (
 select doc_id, count(distinct p) as n_hit from met, unnest(range(i, i + size)) as t(p) group by doc_id),
found as (
 select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
 from (select distinct doc_id, cast(item_id as varchar) as item_id from met) t group by doc_id),
contamination as (
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
 from doc_words left join hit using (doc_id) left join found using (doc_id))"""

DECONTAMINATION = f"with {CONTAMINATION_CTES.format(documents='documents')} select * from contamination"


TOP_K = """
with v as (
 select vec_id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
 from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
scores as (
 select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
 from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (
 select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
 from scores)
select * from ranked where rank <= 5"""


def _vector_codes(parts: int, entries: int, rounds: int) -> str:
    """Codebooks round by round; every part is compared with every entry."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
assigned{i} as (
 select r, p, any_value(part) as part, min(struct_pack(d := gap, e := e)) as best from (
  select r, v.p, v.part, b.e, cast(list_sum(list_transform(list_zip(v.part, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as gap
  from v join book{i} b on v.p = b.p) t group by r, p)""")
        if i < rounds:
            steps.append(f"""
means{i} as (
 select p, e, list(cast((total - ((total % n) + n) % n) // n as bigint) order by k) as c from (
  select p, best.e as e, k, sum(part[k]) as total, count(*) as n
  from assigned{i}, unnest(range(1, len(part) + 1)) as t(k) group by p, best.e, k) t group by p, e),
book{i + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from book{i} b left join means{i} m on b.p = m.p and b.e = m.e)""")
    return f"""
with w as (
 select vec_id, label, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x
 from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
numbered as (select *, row_number() over (order by vec_id nulls last, x) as r, len(x) // {parts} as size from w),
v as (
 select r, p, x[(p - 1) * size + 1 : p * size] as part from numbered, unnest(range(1, {parts} + 1)) as t(p)),
book0 as (select p, r - 1 as e, part as c from v where r <= {entries}),{','.join(steps)},
codes as (
 select r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' order by p) as code, cast(sum(best.d) as bigint) as error
 from assigned{rounds} group by r),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from codes join numbered using (r), books"""


DIVERGENCE = """
with d as (
 select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r
 from documents),
tokens as (
 select r, lang, source, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
 from d),
kept as (select lang, term, count(*) as n from tokens group by lang, term having count(distinct r) >= 3),
langs as (
 select lang, count(term) as v, coalesce(sum(n), 0) as total from (select distinct lang from d) l left join kept using (lang) group by lang),
counts as (select lang, source, term, count(*) as n from tokens join kept using (lang, term) group by lang, source, term),
sources as (
 select lang, source, coalesce(sum(n), 0) as total
 from (select distinct lang, source from d) s left join counts using (lang, source) group by lang, source),
dense as (
 select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
  1 + 1000000000 * (cast(coalesce(c.n, 0) as hugeint) + 1) // (s.total + l.v) as p,
  1 + 1000000000 * (cast(k.n as hugeint) + 1) // (l.total + l.v) as q
 from sources s join langs l on s.lang = l.lang join kept k on k.lang = s.lang
 left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (
 select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
 from sources a join sources b on a.lang = b.lang and a.source <> b.source
 left join dense x on x.lang = a.lang and x.source = a.source
 left join dense y on y.lang = b.lang and y.source = b.source and y.term = x.term
 group by a.lang, a.source, b.source),
rows as (
 select lang, source, 'pair' as part, item, value from pairs
 union all
 select lang, source, 'term', term, (p - q) * (p - q) // q from dense where n > 0 and p > q),
ranked as (
 select lang, source, part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank
 from rows)
select * from ranked where part = 'pair' or rank <= 200"""

# Bytes as hexadecimal text: a string of 200 bytes has 400 digits.
REPEATED_STRINGS = """
with t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
starts as (
 select r, i, md5_number(hex(array_slice(b, i + 1, i + 200))) as s
 from t, unnest(range(0, octet_length(b) - 199)) as u(i)),
again as (select s from starts group by s having count(*) > 1),
hits as (select r, i from starts join again using (s)),
islands as (
 select r, i, sum(new) over (partition by r order by i) as island from (
  select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as new from hits) h),
spans as (select r, min(i) as first, max(i) + 200 as past from islands group by r, island),
edges as (
 select r, coalesce(lag(past) over (partition by r order by first), 0) as first, first as past from spans
 union all select r, max(past), 2147483647 from spans group by r),
parts as (
 select r, string_agg(hex(array_slice(b, first + 1, least(past, octet_length(b)))), '' order by first) as kept
 from edges join t using (r) group by r),
removed as (select r, sum(past - first) as n_removed, count(*) as n_spans from spans group by r)
select doc_id, octet_length(b) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
 cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(coalesce(unhex(kept), b)) as kept_sha256
from t left join parts using (r) left join removed using (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": JACCARD,
        "op4_top_k": TOP_K,
        "op7_decontamination": DECONTAMINATION,
        "op11_vector_codes": _vector_codes(16, 64, 2),
        "op12_source_divergence": DIVERGENCE,
        "op13_suffix_dedup": REPEATED_STRINGS,
    }
