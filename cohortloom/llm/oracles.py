"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

NEAR_DUPLICATES = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s
  from words
), items as (
  select doc_id, unnest(list_transform(s, lambda x: hash(x))) as g from sets
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from items x join items y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * c >= 75 * (len(x.s) + len(y.s) - c)
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as r from documents
  union
  select reach.doc_id, edges.b from reach join edges on edges.a = reach.r
), component as (
  select doc_id, min(r) as component_id from reach group by 1
)
select doc_id, len(s)::bigint as n_shingles, component_id, component_id = doc_id as kept from sets join component using (doc_id)
"""

NEAR_VECTORS = """
with recursive usable as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit as (
  select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from usable
), links as (
  select x.vec_id as a, y.vec_id as b from unit x join unit y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93
), reach as (
  select vec_id, vec_id as r from embeddings
  union
  select reach.vec_id, links.b from reach join links on links.a = reach.r
), component as (
  select vec_id, min(r) as component_id from reach group by 1
), counts as (
  select a as vec_id, count(*) as n from links group by 1
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, component_id = vec_id as kept
from component left join counts using (vec_id)
"""

DECONTAMINATION = """
with words as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents
), items as (
  select item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
), sizes as (
  select distinct k from windows
), grams as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes)
), found as (
  select doc_id, item_id, k, i from grams join windows using (k, g)
), covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from found) group by 1
), named as (
  select doc_id, list_sort(list(distinct item_id::varchar)) as ids from found group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from words left join covered using (doc_id) left join named using (doc_id)
"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: crc32 by its table of 256 entries, which a rule makes; the levels above 8 ** 8 leaves a language are left out.
MANIFEST = (
    """
with recursive bits as (
  select i::bigint as i, i::bigint as v, 0 as step from range(256) r(i)
  union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from bits where step < 8
), crc as (
  select list(v order by i) as t from bits where step = 8
), leaves as (
  select doc_id, lang, sha256("""
    + _HEAD + " || " + _FIELD.format("text") + """) as leaf, sha256(""" + _HEAD + " || " + _FIELD.format(_LOWER) + """) as lower_leaf,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 3 = 0 as hit
  from documents, crc
), placed as (
  select *, row_number() over (partition by lang order by doc_id) - 1 as r, count(*) over (partition by lang) as n from leaves
), level0 as (
  select lang, r, n, leaf as h from placed
)"""
    + "".join(
        f""", level{i} as (
  select lang, r // 8 as r, (n + 7) // 8 as n, case when n > 1 then sha256(string_agg(h, '' order by r)) else min(h) end as h from level{i - 1} group by lang, r // 8, n
)""" for i in range(1, 9))
    + """, heads as (
  select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as r, count(*) over () as n from level8
), upper0 as (
  select r, n, subroot as h from heads
)"""
    + "".join(
        f""", upper{i} as (
  select r // 8 as r, (n + 7) // 8 as n, case when n > 1 then sha256(string_agg(h, '' order by r)) else min(h) end as h from upper{i - 1} group by r // 8, n
)""" for i in range(1, 5))
    + """, steps as (
"""
    + " union all ".join(
        f"""select p.doc_id, {i} as step, string_agg(l.h, '' order by l.r) filter (l.r < p.r // {8 ** i}) as a, string_agg(l.h, '' order by l.r) filter (l.r > p.r // {8 ** i}) as b
  from placed p join level{i} l on l.lang is not distinct from p.lang and l.r // 8 = p.r // {8 ** (i + 1)} where l.n > 1 group by 1""" for i in range(8))
    + " union all "
    + " union all ".join(
        f"""select p.doc_id, {8 + i}, string_agg(l.h, '' order by l.r) filter (l.r < e.r // {8 ** i}), string_agg(l.h, '' order by l.r) filter (l.r > e.r // {8 ** i})
  from placed p join heads e on e.lang is not distinct from p.lang join upper{i} l on l.r // 8 = e.r // {8 ** (i + 1)} where l.n > 1 group by 1""" for i in range(4))
    + """
), paths as (
  select doc_id, list({'a': coalesce(a, ''), 'b': coalesce(b, '')} order by step) as path from steps group by 1
), folded as (
  select p.doc_id, leaf, subroot, (select h from upper4) as root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.a || s.b), ''), '')) as proof_sha256,
    list_reduce(list_prepend({'a': case when hit then lower_leaf else leaf end, 'b': ''}, coalesce(path, [])),
      lambda x, s: {'a': sha256(s.a || x.a || s.b), 'b': ''}).a as folded_root
  from placed p left join paths using (doc_id) join heads e on e.lang is not distinct from p.lang
)
select *, folded_root = root as verified from folded
"""
)

VECTOR_CODES = (
    """
with rows_ as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] as v from rows_, range(4) r(p)
), book0 as materialized (
  select p, dense_rank() over (order by vec_id) - 1 as e, v as c from parts where vec_id in (select vec_id from rows_ order by vec_id limit 256)
)"""
    + "".join(
        f""", near{i} as materialized (
  select vec_id, label, x.p, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) as m
  from parts x join book{i} b on b.p = x.p group by 1, 2, 3, 4
), means{i} as materialized (
  select p, e, list(f order by k) as c from (
    select p, e, k, floor(sum(y) / count(*))::bigint as f from (
      select p, m.e as e, unnest(range(1, len(v) + 1)) as k, unnest(v) as y from near{i}) group by 1, 2, 3) group by 1, 2
), book{i + 1} as materialized (
  select b.p, b.e, coalesce(a.c, b.c) as c from book{i} b left join means{i} a on a.p = b.p and a.e = b.e
)""" for i in range(4))
    + """, last_ as materialized (
  select vec_id, label, x.p, min({'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) as m
  from parts x join book4 b on b.p = x.p group by 1, 2, 3, x.v
), coded as (
  select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from last_ group by 1, 2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book4) as codebooks_sha256
from coded
"""
)
