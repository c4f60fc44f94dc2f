"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK, RING, SPLITS, STEP

#: The same schedule, counted straight from the golden-ratio points, and each document's part from where it starts.
OP9 = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as key
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as place from s0),
s2 as (select *, [5.0::double, 2.0::double, 1.0::double][(place % 3 + 1)::int] as weight, source_size::double * 2 as cap from s1),
s3 as (select *, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double) as before,
         sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as after,
         (sum(source_size) over ())::double * 1.5::double as total_all from s2),
s4 as (select *, case when (total_all - before) / after * weight <= cap then (total_all - before) / after end as level from s3),
s5 as (select *, (select l.level from s4 l where l.level is not null order by l.cap / l.weight, l.place limit 1) as first_level,
         (select min(l.cap / l.weight) from s4 l where l.level is not null) as from_ratio from s4),
s6 as (select *, case when cap / weight < from_ratio or first_level is null then cap else first_level * weight end as target from s5),
s7 as (select *, sum(target) over () as total, sum(target) over (order by place) as high from s6),
s8 as (select *, round((high - target) / total * {RING})::bigint as lo, round(high / total * {RING})::bigint as hi,
         ceil(source_size / {BLOCK}.0)::bigint as blocks from s7),
n as (select s8.place, count(*)::bigint as slots from (select unnest(range(0, ceil((select max(total) from s8) / {BLOCK})::bigint)) as slot) p
      join s8 on (p.slot % {RING} * {STEP} % {RING}) >= s8.lo and (p.slot % {RING} * {STEP} % {RING}) < s8.hi group by s8.place),
w as (select s8.source, s8.source_size, s8.target, greatest(1, s8.blocks) as blocks, least(coalesce(n.slots, 0), 2 * s8.blocks) as slots from s8 left join n on n.place = s8.place),
o as (select *, coalesce(sum(size) over (partition by source order by ('0x' || substr(key, 1, 8))::bigint % {SPLITS}, key, doc_id, size
         rows between unbounded preceding and 1 preceding), 0)::bigint as start from d)
select o.doc_id, o.source, o.size, w.source_size, w.target::double as target,
       (o.size * (w.slots // w.blocks) + greatest(0, least(o.start + o.size, w.slots % w.blocks * {BLOCK}) - o.start))::bigint as taken
from o join w on o.source is not distinct from w.source
"""

OP5 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

OP10 = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
