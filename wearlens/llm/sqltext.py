"""DuckDB SQL of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_words(_ALNUM)} as w from documents),
i as (select item_id, {_words(_ALNUM)} as w from benchmark where item_id is not null),
iw as (
  select distinct cast(item_id as varchar) as item, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as k, least(10, len(w)) as n
  from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)
),
dw as (
  select r, s, n, array_to_string(w[s : s + n - 1], ' ') as k
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw))
),
hit as (select r, s, dw.n, item from dw join iw using (k)),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hit) group by r),
t as (select r, list_sort(list(distinct item)) as items from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)
"""


_SPACED = r"[^\x20\x09-\x0D]+"

JACCARD = f"""
with recursive d as (select row_number() over () as r, doc_id, {_words(_SPACED)} as w from documents),
s as (
  select distinct r, k from (select r, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as k from d)
),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.k = b.k and a.r < b.r group by all),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
t as (select r, r as o from d union select t.r, e.b from t join e on t.o = e.a)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(o.doc_id) as component_id
from t join d on d.r = t.r join d o on o.r = t.o left join n on n.r = t.r group by t.r, d.doc_id
"""

QUALITY_RULES = f"""
with d as (
  select row_number() over () as r, doc_id, source as host, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents
),
g as (select r, s, array_to_string(w[s : s + 2], ' ') as k from (select r, w, unnest(range(1, len(w) - 1)) as s from d)),
c as (select r, unnest(range(s, s + 3)) as p from (select *, count(*) over (partition by r, k) as times from g) where times > 1),
q as (select r, count(distinct p) as n_repeat_words from c group by r),
l as (
  select r, host, md5(x) as copy, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_SPACED}') as lw
  from (select r, host, x, unnest(string_split(x, chr(10))) as line from d)
),
m as (select r, host, copy, line, array_to_string(lw, ' ') as k, len(lw) as size from l where len(lw) > 0),
u as (select r, count(*) - count(distinct line) as n_dup_lines from m group by r),
h as (select host, count(distinct md5(x)) as docs from d group by host),
f as (
  select m.host, k from m join h on m.host is not distinct from h.host group by m.host, k
  having count(distinct copy) >= 20 and count(distinct copy) * count(distinct copy) > max(docs)
),
z as (select r, cast(sum(size) as bigint) as common_words from m join f on m.host is not distinct from f.host and m.k = f.k group by r),
b as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(x, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(common_words, 0) as common_words
  from d left join q using (r) left join u using (r) left join z using (r)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words > 0 and n_words - common_words < 0.5 * n_words) as kept
from b
"""

REPEATS = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, p, substr(h, 2 * p + 1, 100) as k from (select *, unnest(range(0, len(h) // 2 - 49)) as p from d)),
m as (select k, min(doc_id) as least from w group by k),
x as (select r, p from w join m using (k) where least < doc_id),
i as (select r, p, case when p > lag(p) over (partition by r order by p) + 50 then 1 else 0 end as fresh from x),
j as (select r, p, sum(fresh) over (partition by r order by p) as run from i),
s as (select r, run, min(p) as a, max(p) + 50 as b from j group by r, run),
t as (select *, lag(b, 1, 0) over (partition by r order by a) as c from s),
u as (
  select r, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans,
    string_agg(substr(h, cast(2 * c + 1 as bigint), cast(2 * (a - c) as bigint)), '' order by a) || substr(any_value(h), cast(2 * max(b) + 1 as bigint)) as kept
  from t join d using (r) group by r
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join u using (r)
"""

INFILL = """
with d as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
),
g as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as y,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as z, cast('0x' || substr(h, 25, 8) as bigint) % 100 as w
  from d
),
f as (
  select *, least(x, y) as a, greatest(x, y) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or z >= 90 then 'plain' when w < 20 then 'spm' else 'psm' end as form
  from g
),
p as (select *, substr(t, 1, a) as head, substr(t, a + 1, b - a) as body, substr(t, b + 1) as tail from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || body else '<S>' || tail || '<P>' || head || '<M>' || body end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def _round(i: int) -> str:
    """Assignment a{i} to the centroids c{i}, and the centroids c{i + 1} of its clusters."""
    return f"""
q{i} as (select r, k, cast(sum((x - y) * (x - y)) as bigint) as d from e join c{i} using (j) group by r, k),
a{i} as (select r, min(k) as k, min(d) as d from (select *, min(d) over (partition by r) as least from q{i}) where d = least group by r),
s{i} as (select k, j, sum(x) as s, count(*) as n from e join a{i} using (r) group by k, j),
c{i + 1} as (
  select k, j, case when n is null then y else cast((s - ((s % n) + n) % n) // n as bigint) end as y from c{i} left join s{i} using (k, j)
),"""


#: 16 centroids, three rounds, 64 components.
CENTROIDS = f"""
with v as (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda u: u is not null and isfinite(cast(u as double)))) = 64
),
e as (select r, j, cast(floor(64 * cast(embedding[j] as double)) as bigint) as x from (select r, embedding, unnest(range(1, 65)) as j from v)),
o as (select r, row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), embedding) - 1 as k from v),
c0 as (select k, j, x as y from o join e using (r) where k < 16),
{_round(0)}{_round(1)}{_round(2)}
{_round(3).split("s3 as")[0].rstrip().rstrip(",")},
g as (select k, sum(d) as own from a3 group by k),
z as (select k, sha256(string_agg(cast(y as varchar), ',' order by j)) as centroid_sha256 from c3 group by k)
select vec_id, cast(a3.k as integer) as cluster, a3.d as distance, cast(own as bigint) as cluster_inertia,
  cast((select sum(d) from a3) as bigint) as inertia, centroid_sha256
from a3 join v using (r) join g on g.k = a3.k join z on z.k = a3.k
"""
