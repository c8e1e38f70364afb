"""SQL of the queries that SQL expresses, for the oracle engine."""

from __future__ import annotations

from . import decontaminate, mixing, quality, secrets, urlfilter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _turn(values: tuple, place: str) -> str:
    return f"case ({place} - 1) % {len(values)} " + " ".join(f"when {k} then cast({v} as double)" for k, v in enumerate(values)) + " end"


_A, _B = (_turn([s[k] for s in mixing.SCHEDULES], "place") for k in (0, 1))
_DUE = f"least(1e0, {{at}} / target) * ({_A} + {_B} / 2)"
_POSITION = f"2 * ({_DUE}) / ({_A} + sqrt(greatest(0e0, {_A} * {_A} + 2 * {_B} * ({_DUE}))))"

OP2 = f"""
with r as (select doc_id, source as src, cast(coalesce(len({_WORDS.format('text')}), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as k from documents),
s as (select src, sum(size) as source_size, row_number() over (order by src asc nulls last) as place from r group by src),
t as (select *, {_turn(mixing.WEIGHTS, 'place')} as w, cast(source_size * {mixing.MOST} as double) as cap from s),
u as (select *, coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0) as before,
 sum(w) over (order by cap / w, place rows between current row and unbounded following) as after, cast(sum(source_size) over () as double) * {mixing.BUDGET} as total from t),
v as (select *, (total - before) / after as level, (total - before) / after * w <= cap as fits from u),
l as (select level from v where fits order by cap / w, place limit 1),
g as (select src, cast(source_size as bigint) as source_size, place, least(cap, coalesce((select level from l) * w, cap)) as target from v),
o as (select r.doc_id, r.size, g.source_size, g.target, g.place, coalesce(sum(size) over (partition by r.src order by k rows between unbounded preceding and 1 preceding), 0) as a from r join g on r.src is not distinct from g.src),
p as (select *, greatest(0, least(size, floor(target + 5e-1) - a)) as t1, greatest(0, least(size, floor(target + 5e-1) - a - source_size)) as t2 from o)
select doc_id, size, source_size, target, cast(t1 + t2 as bigint) as taken, round(case when t1 > 0 then {_POSITION.format(at='a')} end, 9) as position_1,
 round(case when t2 > 0 then {_POSITION.format(at='(a + source_size)')} end, 9) as position_2 from p
"""

_RULES = ", ".join("('{}', '{}', '{}', {})".format(r.text.replace("'", "''"), r.verdict, r.pattern.replace("'", "''"), r.listed) for r in urlfilter.RULES)
OP3 = f"""
with rules(rule, verdict, pattern, listed) as (values {_RULES}),
p as (select page_id, row_number() over () as rn, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select rn, arg_max(struct_pack(rule := rule, verdict := verdict, listed := listed), (listed, length(rule), cast(verdict = 'block' as int), rule)) as b from p join rules on regexp_matches(host || path, pattern) group by rn)
select page_id, host, path, case when b.listed = 1 then b.rule end as rule, coalesce(b.verdict, 'allow') as verdict from p left join m using (rn)
"""

_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"
OP4 = f"""
with i as (select item_id, {_SHINGLES} as s from (select item_id, {_TOKENS} as w from benchmark) x where len(w) > 0),
d as (select doc_id, text, {_SHINGLES} as s from (select distinct doc_id, text, {_TOKENS} as w from documents) x where len(w) > 0),
e as (select item_id, len(s) as n, unnest(s) as g from i), f as (select doc_id, text, unnest(s) as g from d)
select distinct doc_id, item_id, item_shingles, common, containment from (
select doc_id, text, item_id, n as item_shingles, count(*) as common, count(*) / n as containment from e join f using (g) group by doc_id, text, item_id, n having count(*) >= ceil(n * {decontaminate.CONTAINED})) y
"""

OP5 = f"""
with d as (select doc_id, source, coalesce(text, '') as text, row_number() over () as rn from documents),
w as (select *, {_WORDS.format('text')} as ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select rn, i, list_slice(ws, i, i + 7) as win from (select rn, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8) x),
h as (select rn, i, count(*) over (partition by rn, win) as c from g),
rep as (select rn, count(*) as n from (select distinct rn, unnest(range(i, i + 8)) as p from h where c > 1) x group by rn),
u as (select source, text, count(*) as docs from d group by source, text),
ln as (select source, text, docs, unnest(string_split(translate(text, '{_UPPER}', '{_LOWER}'), chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from u),
lk as (select source, text, max(docs) as docs, key, min(i) as pos, sum(len(key)) as n from (select *, {_WORDS.format('line')} as key from ln) x where len(key) > 0 group by source, text, key),
nt as (select source, count(*) as n_texts, sum(docs) as n_docs from u group by source),
ca as (select k.source, k.key, held, n_texts from (select source, key, count(*) as held, sum(docs) as by_docs from lk group by source, key) k join nt on k.source is not distinct from nt.source where by_docs > {quality.LINE_DOCS} and by_docs > {quality.LINE_SHARE} * n_docs),
al as (select source, text, sum(n) as words from lk group by source, text),
ho as (select lk.source, lk.text, lk.key, n, pos, held, n_texts from lk join ca on lk.source is not distinct from ca.source and lk.key = ca.key),
fa as (select ho.source, ho.text, 2 * sum(n) > max(words) as most, arg_min(cast(key as varchar), (held, pos)) as rarest from ho join al on ho.source is not distinct from al.source and ho.text = al.text group by ho.source, ho.text),
un as (select distinct ho.source, key, n_texts, most, case when most then rarest else ho.text end as one from ho join fa on ho.source is not distinct from fa.source and ho.text = fa.text),
fr as (select source, key from un group by source, key having count(*) > {quality.LINE_DOCS} and count(*) > {quality.LINE_SHARE} * max(n_texts)),
gone as (select lk.source, lk.text, sum(case when fr.key is not null then n else 0 end) / sum(n) as gone from lk left join fr on lk.source is not distinct from fr.source and lk.key = fr.key group by lk.source, lk.text),
b as (select doc_id, source, text, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
 cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from w left join rep using (rn)),
c as (select b.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(gone, 0) as removed_share from b left join gone on b.source is not distinct from gone.source and b.text = gone.text)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (removed_share > {quality.DEPLETED_SHARE} or removed_share > 0 and round(n_words * (1 - removed_share)) < {quality.LEFT_WORDS}) as kept, removed_share from c
"""

OP8 = f"""
with recursive d as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: list_slice(w, i, i + 4))) end as s from d),
n as (select doc_id, len(s) as n from s), g as (select doc_id, unnest(s) as g from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
r(x, y) as (select doc_id, doc_id from d union select r.x, l.y from r join l on r.y = l.x)
select doc_id, cast(n as bigint) as n_shingles, min(y) as component_id from n join r on r.x = doc_id group by doc_id, n
"""


def _kind(k: int, rule: secrets.Rule) -> str:
    # case-insensitive letters are spelled out: the oracle's engine would fold beyond ASCII
    pattern = rule.pattern
    if "(?i:" in pattern:
        inner = "password|passwd|secret|token|api_?key"
        pattern = pattern.replace(f"(?i:({inner}))", "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in inner) + ")")
    p = pattern.replace("'", "''")
    return (
        f"select rn, {k} as k, start as s, start + m as e, v from (select rn, unnest(list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x))) as m, unnest(list_transform(regexp_extract_all(text, '{p}', {rule.group}), lambda x: length(x))) as v, "
        f"unnest(list_transform(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1), lambda i: length(array_to_string(list_slice(regexp_split_to_array(text, '{p}'), 1, i), '')) + length(array_to_string(list_slice(regexp_extract_all(text, '{p}', 0), 1, i - 1), '')))) as start from d where regexp_matches(text, '{p}')) x where v >= {rule.least}"
    )


_SPANS = " union all ".join(_kind(k, r) for k, r in enumerate(secrets.RULES))
_NAME = "case k " + " ".join(f"when {k} then '{r.kind}'" for k, r in enumerate(secrets.RULES)) + " end"
_JOINED = f"string_agg({_NAME} || ':' || s || ':' || e, ',' order by s, k, e)"
OP9 = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rn from documents), x as ({_SPANS}),
a as (select rn, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, {_JOINED} filter (where k < {len(secrets.BASE)}) as base, {_JOINED} as spans from x group by rn)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rn)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, i * 5 + 1, 5) as bigint) >> {}) & 31 as int) + 1, 1)"
OP10 = f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages), l as (select h, min(page_id) as lead from p group by h)
select page_id, cast(strlen(t) as bigint) as payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}), '') as payload_digest,
 case when page_id is not distinct from lead then 'response' else 'revisit' end as record_type, case when page_id is distinct from lead then lead end as refers_to from p join l using (h)
"""

ORACLES = {
    "op2_mixing": OP2, "op3_url_filters": OP3, "op4_decontamination": OP4, "op5_quality_rules": OP5, "op8_ngram_jaccard": OP8, "op9_secret_scans": OP9, "op10_warc": OP10,
}
