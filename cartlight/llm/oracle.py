"""DuckDB SQL of the text operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

from cartlight.llm.licences import KNOWN, SPELLINGS

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NGRAM_JOIN = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents
), items as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) as item from words
), sizes as (select doc_id, count(*) as n from items group by 1),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from items a join items b on a.item = b.item and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * k >= 90 * (x.n + y.n - k)
), both_ways as (select a, b from links union select b, a from links),
reach as (select a as doc_id, a as other from both_ways union
  select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.other
), low as (select doc_id, min(other) as component_id from reach group by 1),
sets as (select doc_id, list(item order by item) as s from items group by 1),
same as (select doc_id, min(doc_id) over (partition by s) as class_id from sets)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(c.class_id, d.doc_id) as class_id,
  coalesce(l.component_id, d.doc_id) as component_id
from documents d left join sizes s using (doc_id) left join low l using (doc_id) left join same c using (doc_id)
"""

_LINE_DEDUP = """
with lines as (select doc_id, text, string_split(text, chr(10)) as l from documents),
windows as (
  select doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] as w
  from (select doc_id, l, unnest(range(0, len(l) - 2)) as pos from lines where len(l) >= 3)
), later as (
  select doc_id, pos from (select *, row_number() over (partition by w order by doc_id, pos) as k from windows) where k > 1
), gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as pos from later),
stretches as (
  select doc_id, count(*) as n, count(*) filter (where before is null or before < pos - 1) as spans
  from (select *, lag(pos) over (partition by doc_id order by pos) as before from gone) group by 1
), left_over as (
  select x.doc_id, string_agg(x.line, chr(10) order by x.pos) as kept
  from (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as pos from lines) x
  anti join gone on gone.doc_id = x.doc_id and gone.pos = x.pos group by 1
)
select d.doc_id, coalesce(len(d.l), 0)::bigint as n_lines, coalesce(s.n, 0)::bigint as n_removed,
  coalesce(s.spans, 0)::bigint as n_spans, md5(coalesce(k.kept, '')) as kept_md5
from lines d left join stretches s using (doc_id) left join left_over k using (doc_id)
"""


def _canonical(text: str) -> str:
    line = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\p{L}\n]*(\(c\)|©|[0-9]{4})[^\n]*$"
    made = f"trim(regexp_replace(regexp_replace(lower({text}), '{line}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, replacement in SPELLINGS:
        made = f"replace({made}, '{pattern}', '{replacement}')"
    return made


def _licence_scan() -> str:
    quote = chr(39)
    known = ", ".join(
        f"('{name}', '{text.replace(quote, quote * 2)}')" for name, text in KNOWN
    )
    return f"""
with known as (
  select sha256({_canonical("t")}) as digest, min(name) as licence from (values {known}) v(name, t) group by 1
), scanned as (select doc_id, text, sha256({_canonical("coalesce(text, '')")}) as digest from documents),
found as (
  select doc_id, array_to_string(list_sort(list_distinct(list(k.licence))), ',') as notices, count(*) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) x
  join known k on k.digest = sha256({_canonical("x.line")}) group by 1
)
select s.doc_id, s.digest, k.licence, coalesce(f.notices, '') as notices, coalesce(f.n, 0)::bigint as n_notices
from scanned s left join known k using (digest) left join found f using (doc_id)
"""


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_DECONTAMINATION = f"""
with items as (select distinct item_id, {_words("coalesce(text, '')")} as w from benchmark),
windows as (
  select item_id, least(len(w), 10) as m, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as t
  from items where len(w) > 0
), docs as (select doc_id, {_words("coalesce(text, '')")} as w from documents),
sizes as (select distinct m from windows),
places as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as t
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, sizes where len(w) >= m)
), found as (select p.doc_id, p.i, p.m, x.item_id from places p join windows x on x.m = p.m and x.t = p.t),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from found) group by 1),
named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from found) group by 1
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit,
  coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.ids, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hits h using (doc_id) left join named n using (doc_id)
"""


_HARD_NEGATIVES = """
with taking as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), anchors as (select * from taking where vec_id % 50 = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from anchors a join taking r on a.vec_id <> r.vec_id
), positives as (
  select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.vec_id as positive_id,
  row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""


def _conversation_repair() -> str:
    """Recursion over a conversation's rows, with the cheapest (cost, audit, lines) of each state as strings."""
    then, kept = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    roles = {2: "user", 3: "assistant"}
    ways: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}

    def way(state: int, inserted: list[int], op: str, cost: str, line: str, needs: str) -> str:
        lines = "".join(f" || chr(10) || '{roles[s]}:'" for s in inserted) + line
        audit = "I" * len(inserted) + op
        return (f"case when s[{state + 1}] is not null and {needs} then {{'c': s[{state + 1}].c + {2 * len(inserted)} + {cost}, "
                f"'a': s[{state + 1}].a || '{audit}', 'o': s[{state + 1}].o{lines}}} end")

    for state in range(4):
        now, inserted = state, []
        for _ in range(3):
            ways[now].append(way(state, inserted, "D", "3", "", "true"))
            ways[then[now]].append(way(state, inserted, "R", "2 + cut", f" || chr(10) || '{roles[then[now]]}:' || text", "not gone"))
            for (origin, initial), target in kept.items():
                if origin == now:
                    ways[target].append(way(
                        state, inserted, "K", "cut", " || chr(10) || role || ':' || text", f"not gone and left(role, 1) = '{initial}'"))
            now = then[now]
            inserted = [*inserted, now]
    states = ", ".join(f"list_sort(list_filter([{', '.join(w)}], lambda x: x is not null))[1]" for w in ways.values())
    none = "null::struct(c bigint, a varchar, o varchar)"
    ends = ", ".join(
        f"case when s[{k + 1}] is not null then {{'c': s[{k + 1}].c + {2 * len(e)}, 'a': s[{k + 1}].a || '{'I' * len(e)}', "
        f"'o': s[{k + 1}].o{''.join(f" || chr(10) || '{x}:'" for x in e)}}} end"
        for k, e in enumerate([[], ["user", "assistant"], ["assistant"], []])
    )
    return rf"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, t,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as b
  from conversations, crc
), faulty as (
  select conv_id, turn, role, text,
    xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 as fault
  from keyed
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then translate(text, '.!?', '') else text end as text,
    unnest(case fault when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from faulty
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) || left(role, 1) as pair
  from damaged
), repeated as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as seen from ordered
), judged as materialized (
  select *, seen and not blank as duplicate, blank or seen as gone,
    (not blank and not seen and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'))::int as cut
  from repeated
), walk as (
  select distinct conv_id, 0::bigint as i, [{{'c': 0::bigint, 'a': '', 'o': ''}}, {none}, {none}, {none}] as s from conversations
  union all
  select w.conv_id, j.i, [{states}] as s from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1
), ended as (
  select conv_id, list_sort(list_filter([{ends}], lambda x: x is not null))[1] as best
  from walk qualify row_number() over (partition by conv_id order by i desc) = 1
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank,
    count(*) filter (where duplicate) as duplicate, sum(cut)::bigint as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from judged group by 1
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
  sha256(substring(best.o, 2)) as repaired_sha256
from ended e left join facts f on f.conv_id is not distinct from e.conv_id
"""


def sql() -> dict[str, str]:
    return {
        "op1_ngram_join": _NGRAM_JOIN,
        "op3_line_dedup": _LINE_DEDUP,
        "op6_licence_scan": _licence_scan(),
        "op7_decontamination": _DECONTAMINATION,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op12_conversation_repair": _conversation_repair(),
    }
