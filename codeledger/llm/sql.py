"""DuckDB SQL for the corpus queries that SQL can express in full.

Those are the secret scan, the personal data, the lexical search and the repair of conversations:
tokenizers, fitted models, SimHash components and rebuilt media aren't SQL, and are held against
brute force in tests/llm.  The expressions are
the contract's plain ones.  Spans come from the pieces between matches, as in the operators, but
over one window instead of arrays.
"""

from __future__ import annotations

#: (kind, rank, expression, least length of the match) of the secret scan; assign is measured by its value.
_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    ("assign", 0, _ASSIGN),
    ("access", 1, r"AKIA[A-Z0-9]{16,}"),
    ("hex", 2, r"[0-9a-f]{24,}"),
    ("pem", 3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("forge", 4, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat", 5, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]


def _secret_scans() -> str:
    hits = " union all ".join(
        f"select r, '{k}' as kind, {n} as rank, string_split_regex(t, '{p}') as between, regexp_extract_all(t, '{p}') as hits, "
        + (f"regexp_extract_all(t, '{p}', 1)" if k == "assign" else "regexp_extract_all(t, '')")
        + f" as vals from d where regexp_matches(t, '{p}')"
        for k, n, p in _KINDS
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
raw as ({hits}),
one as (select r, kind, rank, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(between[1:len(hits)]) as gap,
  unnest(case when kind = 'assign' then vals else hits end) as val from raw),
pos as (select *, sum(length(gap) + length(hit)) over (partition by r, kind order by i) as e from one),
kept as (select r, kind, rank, cast(e - length(hit) as bigint) as s, cast(e as bigint) as e from pos where kind <> 'assign' or length(val) >= 6),
agg as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from kept group by r)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (r)
"""


_ENTITIES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[ -]?[0-9])+"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
]


def _personal_data(alpha: float) -> str:
    hits = " union all ".join(f"select r, '{k}' as kind, {n} as rank, string_split_regex(t, '{p}') as between, regexp_extract_all(t, '{p}') as hits from d where regexp_matches(t, '{p}')" for n, (k, p) in enumerate(_ENTITIES))
    digit = "cast(substr(dg, length(dg) - i, 1) as int)"
    luhn = f"list_sum(list_transform(range(0, length(dg)), lambda i: case when i % 2 = 0 then {digit} else (2 * {digit}) % 10 + {digit} // 5 end)) % 10 = 0"
    word = _ENTITIES[0][1] + "|[\\p{L}]{4,}"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
raw as ({hits}),
one as (select r, kind, rank, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(between[1:len(hits)]) as gap from raw),
pos as (select *, cast(sum(length(gap) + length(hit)) over (partition by r, kind order by i) as bigint) as e, regexp_replace(hit, '[^0-9]', '', 'g') as dg from one),
base as (select r, kind, rank, e - length(hit) as s, e, hit from pos where case kind
  when 'ip' then len(list_filter(string_split(hit, '.'), lambda x: not regexp_full_match(x, '0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 0
  when 'card' then length(dg) between 13 and 19 and {luhn}
  when 'phone' then length(dg) between 9 and 15 else true end),
entity as (select distinct r, kind || ':' || hit as entity from base),
cut as (select r, string_split_regex(t, '{word}') as between, regexp_extract_all(t, '{word}') as hits from d where r in (select r from base)),
wrd as (select r, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(between[1:len(hits)]) as gap from cut where len(hits) > 0),
plc as (select r, lower(hit) as term, length(hit) as n, cast(sum(length(gap) + length(hit)) over (partition by r order by i) as bigint) as e from wrd),
around as (select r, term, e - n as s, e from plc where not contains(term, '@')),
joint as (select entity, term, count(*) as c_et from entity join (select distinct r, term from around) using (r) group by 1, 2),
per_e as (select entity, count(*) as c_e from entity group by 1),
per_t as (select term, count(*) as c_t from (select unnest(list_distinct(list_transform(regexp_extract_all(t, '[\\p{{L}}]{{4,}}'), lambda x: lower(x)))) as term from d) group by 1),
size as (select cast(count(*) as double) as n from d),
pairs as (select entity, term from joint join per_e using (entity) join per_t using (term), size
  where c_e < n and log2(n * c_et / (c_e * c_t)) >= {alpha} * log2(n / c_e) - 1e-9),
term as (select distinct r, 'term' as kind, 4 as rank, s, e from around join entity using (r) join pairs using (entity, term)),
every as (select r, kind, rank, s, e from base union all select * from term),
agg as (select r, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) filter (rank < 4) as base, string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) as spans from every group by r)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (r)
"""


def _conversation_repair() -> str:
    edit = lambda s, cost, letter: f"struct_pack(c := {s}.c + {cost}, a := {s}.a || {letter})"
    ins = lambda s: edit(s, 5, "'I'")
    u_of = lambda s: edit(s, "u_cost", "u_letter")
    low = lambda *x: f"list_min([{', '.join(x)}])"
    return f"""
with recursive tab as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as b from conversations),
marked as (select raw.*, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 20 as h from raw, tab),
damaged as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
  case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from marked, (values (0), (1)) v(k) where h <> 0 and (k = 0 or h = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by pos) > 1 as again, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by pos) as before,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) as last from placed),
flags as (select *, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and last not in ('.', '!', '?') as truncated,
  before is not null and before || i not in ('su', 'ua', 'au') as illegal from seen),
costs as (select *, case when truncated then 5 else 0 end as late, blank or duplicate as must from flags),
step as (select conv_id, pos, role, text, case when must or i <> 's' then 1000000000000 else late end as s_cost,
  case when must then 1000000000000 when i = 'u' then late else late + 1 end as u_cost, case when i = 'u' then 'K' else 'R' end as u_letter,
  case when must then 1000000000000 when i = 'a' then late else late + 1 end as a_cost, case when i = 'a' then 'K' else 'R' end as a_letter from costs),
keys as (select distinct conv_id from conversations),
walk as (
  select conv_id, 0::bigint as pos, struct_pack(c := 0::bigint, a := '') as st, struct_pack(c := 1000000000000, a := '') as sy,
    struct_pack(c := 5::bigint, a := 'I') as u, struct_pack(c := 10::bigint, a := 'II') as a from keys
  union all
  select conv_id, pos, st, sy, u1 as u, {low("a0", ins("u1"))} as a from (
    select conv_id, pos, st, sy, a0, {low("u0", ins("st"), ins("sy"), ins("a0"))} as u1 from (
      select w.conv_id, s.pos, {edit("st", 2, "'D'")} as st, {low(edit("sy", 2, "'D'"), edit("st", "s_cost", "'K'"))} as sy,
        {low(edit("u", 2, "'D'"), u_of("st"), u_of("sy"), u_of("a"))} as u0, {low(edit("a", 2, "'D'"), edit("u", "a_cost", "a_letter"))} as a0
      from walk w join step s on w.conv_id is not distinct from s.conv_id and s.pos = w.pos + 1))),
last as (select conv_id, max_by({low("st", "a")}, pos) as best from walk group by conv_id),
letters as (select conv_id, best, regexp_extract_all(best.a, 'I*[KRD]|I+') as pieces from last),
piece as (select conv_id, unnest(pieces) as p, generate_subscripts(pieces, 1) as pos from letters),
kept as (select p.conv_id, p.pos, x.n, case when x.n < len(p) or right(p, 1) = 'I' then 'I' else right(p, 1) end as letter, s.role, s.text
  from piece p left join step s on p.conv_id is not distinct from s.conv_id and p.pos = s.pos, unnest(range(1, len(p) + 1)) as x(n)),
shown as (select *, row_number() over (partition by conv_id order by pos, n) - 1 as j from kept where letter <> 'D'),
shifted as (select *, max(case when j = 0 and letter = 'K' and left(role, 1) = 's' then 1 else 0 end) over (partition by conv_id) as off from shown),
texts as (select conv_id, string_agg(case when letter = 'K' then role when (j + off) % 2 = 0 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by j) as whole from shifted group by conv_id),
told as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal from flags group by conv_id)
select l.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  best.c as cost, best.a as audit, sha256(coalesce(whole, '')) as repaired_sha256
from letters l left join told t on l.conv_id is not distinct from t.conv_id left join texts x on l.conv_id is not distinct from x.conv_id
"""


_LEXICAL_SEARCH = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents where text is not null),
q as (select item_id, row_number() over () as i, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ws from benchmark where text is not null),
asked as (select i, unnest(ws) as t from q),
total as (select count(*)::bigint as n, sum(len(ws))::bigint as l from d where len(ws) > 0),
tf as (select r, t, count(*)::bigint as tf from (select r, unnest(ws) as t from d) where t in (select t from asked) group by all),
w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by t, n),
m as (select r, doc_id, (10 + (90 * len(ws) * n) // l)::bigint as m from d, total where len(ws) > 0),
score as (select i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join tf using (t) join w using (t) join m using (r) group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from score join q using (i) join m using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


ORACLES = {"op4_secret_scans": _secret_scans(), "op9_personal_data": _personal_data(0.9), "op11_lexical_search": _LEXICAL_SEARCH, "op13_conversation_repair": _conversation_repair()}
