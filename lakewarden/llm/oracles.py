"""DuckDB counterparts of the registered queries, written from their contracts."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {}

ORACLES["op10_decontamination"] = rf"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from benchmark),
bs as (
  select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s
  from bw where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as k from bs),
sizes as (select distinct n from win),
ds as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from dw, sizes where len(w) >= n),
dk as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as k from ds),
hit as (select dk.doc_id, dk.s, dk.n, win.item_id from dk join win on dk.n = win.n and dk.k = win.k),
pos as (select distinct doc_id, unnest(range(s, s + n)) as p from hit),
np as (select doc_id, count(*) as n_hit from pos group by doc_id),
it as (select doc_id, cast(item_id as varchar) as item from hit group by all),
ni as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from it group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from dw left join np on np.doc_id = dw.doc_id left join ni on ni.doc_id = dw.doc_id
"""

ORACLES["op1_quality"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
ln as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, w, unnest(range(1, len(w) - 3)) as s from w where len(w) >= 5),
k as (select doc_id, s, array_to_string(w[s : s + 4], ' ') as k from g),
c as (select doc_id, s, count(*) over (partition by doc_id, k) as n from k),
p as (select distinct doc_id, unnest(range(s, s + 5)) as p from c where n > 1),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
f as (
  select w.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as bigint) as n_capitals,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join ln on ln.doc_id = w.doc_id left join r on r.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 20 * n_words
    or 100 * n_dup_lines > 30 * n_lines or 100 * n_capitals > 50 * word_chars
    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from f
"""

_KINDS = (
    (
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"\'\']?[ ]*[:=][ ]*[\"\'\']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
)


def _spans_of(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
select doc_id, {order} as o, '{kind}' as kind, ends - size as s, ends as e from (
  select doc_id, size, part, sum(gap + size) over (partition by doc_id order by i) as ends from (
    select doc_id, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(m, lambda x: length(x))) as size,
      unnest(list_transform(p, lambda x: length(x))) as part, unnest(list_transform(g[1 : len(m)], lambda x: length(x))) as gap
    from (select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as p,
      string_split_regex(t, '{pattern}') as g from d)))
where part >= {least}"""


ORACLES["op4_secrets"] = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), spans as ("
    + " union all ".join(_spans_of(n, *k) for n, k in enumerate(_KINDS))
    + """),
per as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(concat(kind, ':', s, ':', e), ',' order by s, o) filter (o < 3) as base,
    string_agg(concat(kind, ':', s, ':', e), ',' order by s, o) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per on per.doc_id = d.doc_id"""
)

_CONTROL = ("<|im_start|>", "<|im_end|>", "<|nl|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _length_escaped(column: str) -> str:
    """Code points of an escaped text: one more for each backslash and control string."""
    extra = "".join(
        f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROL)
    )
    return f"length({column}){extra}"


ORACLES["op7_chat"] = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + {_length_escaped("role")} + 1 + {_length_escaped("text")} + 11) as bigint) as formatted_chars
from c group by conv_id"""


def _centroid_rounds(rounds: int = 10) -> str:
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
d{n} as materialized (
  select x.vec_id, c.cluster, cast(sum((x.x - c.x) * (x.x - c.x)) as bigint) as distance
  from comp x join c{n} c on c.place = x.place group by all),
a{n} as materialized (
  select vec_id, arg_min(cluster, distance * 8 + cluster) as cluster, min(distance) as distance from d{n} group by vec_id)""")
        if n < rounds:
            steps.append(f"""
s{n} as (
  select a.cluster, x.place, sum(x.x) as s, count(*) as m
  from a{n} a join comp x on x.vec_id = a.vec_id group by all),
c{n + 1} as materialized (
  select c.cluster, c.place, cast(case when m is null then c.x else (s - ((s % m) + m) % m) // m end as bigint) as x
  from c{n} c left join s{n} s on s.cluster = c.cluster and s.place = c.place)""")
    return ",".join(steps)


ORACLES["op11_centroids"] = f"""
with kept as (
  select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) as v
  from embeddings
  where len(embedding) = 64
    and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
comp as materialized (
  select vec_id, unnest(range(1, 65)) as place, unnest(v) as x from kept),
first as (
  select vec_id, row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 as cluster
  from kept qualify cluster < 8),
c0 as materialized (
  select cast(first.cluster as integer) as cluster, place, x from first join comp on comp.vec_id = first.vec_id),
{_centroid_rounds()},
digests as (
  select cluster, sha256(string_agg(cast(x as varchar), ',' order by place)) as centroid_sha256 from c10 group by cluster),
inner_sums as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a10 group by cluster)
select a.vec_id, a.cluster, a.distance, i.cluster_inertia, (select cast(sum(distance) as bigint) from a10) as inertia, g.centroid_sha256
from a10 a join inner_sums i on i.cluster = a.cluster join digests g on g.cluster = a.cluster
"""

# the CRC-32 of a decimal number, bit by bit: 3988292384 is the reversed polynomial
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, z: case when y % 2 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end)))"""

ORACLES["op13_tries"] = rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as r
  from conversations where conv_id is not null),
convs as (select distinct conv_id, conv_id - conv_id % 20 as base, {_CRC} % 4 as h from t),
taken as (
  select c.conv_id, 0 as own, t.r, t.role, t.text from convs c join t on t.conv_id = c.base where t.r <= c.h
  union all
  select c.conv_id, 1, t.r, t.role, t.text from convs c join t on t.conv_id = c.conv_id where t.r > c.h),
placed as (
  select conv_id, row_number() over (partition by conv_id order by own, r) as d,
    len(list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '')) as words,
    sha256(role || chr(10) || text) as k
  from taken),
paths as (
  select conv_id, d, words, string_agg(k, ',') over (partition by conv_id order by d) as name,
    coalesce(string_agg(k, ',') over (partition by conv_id order by d rows between unbounded preceding and 1 preceding), '') as up,
    max(d) over (partition by conv_id) as n from placed
  union all
  select c.conv_id, 0, 0, '', null, coalesce(max(p.d), 0) from convs c left join placed p on p.conv_id = c.conv_id group by c.conv_id),
nodes as materialized (
  select d as depth, name, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where d = n) as ends
  from paths group by d, name),
children as (select up, count(*) as n_children from nodes where depth > 0 group by up),
below as (
  select a.name, cast(sum((b.n_convs - 1) * b.words) as bigint) as saved_tokens,
    count(*) filter (where c.up is null) as n_leaves
  from nodes a join nodes b on b.depth >= a.depth and (a.name = '' or b.name = a.name or starts_with(b.name, a.name || ','))
  left join children c on c.up = b.name group by a.name)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) as n_children, w.n_leaves, w.saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join below w on w.name = n.name left join children c on c.up = n.name left join nodes p on p.name = n.up
"""
