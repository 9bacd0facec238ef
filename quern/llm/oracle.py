"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from quern.llm import licenses

MIXING = r"""
with docs as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         case l.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as w,
         (('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null') || ':' || md5(coalesce(d.text, ''))), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l using (doc_id)
), keyed as (select *, -ln(u) / w as key from docs),
sizes as (
  select source, sum(size)::bigint as source_size,
         [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from keyed group by source
), ranked as (
  select *, 2.0::double * source_size as most, 1.5::double * sum(source_size) over ()::double as total from sizes
), leveled as (
  select *, (total - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level
  from ranked
), goals as (
  select source, source_size, least(most, w * coalesce((select min_by(level, most / w) from leveled where level * w < most), 1e300::double)) as target
  from leveled
), budget as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs,
         target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end) * source_size as rest
  from goals
), run as (
  select k.doc_id, k.size, b.source_size, b.target, b.epochs, b.rest,
         coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as done
  from keyed k join budget b on k.source is not distinct from b.source
)
select doc_id, size, source_size, target,
       (size * (epochs + case when done + size / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from run
"""

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), told as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
         string_agg(role, '>' order by turn nulls first, role, text) as roles,
         sum(length('<|im_start|>') + 1 + length('<|im_end|>') + 1
             + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
             + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as formatted_chars
  from rows group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars::bigint as formatted_chars, regexp_full_match(roles, '(system>)?user>assistant(>user>assistant)*') as valid
from told
"""

FILTERS = r"""
with m as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), flags as (
  select doc_id, part,
         (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end)
         + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
         + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as mask
  from m
), told as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
cells as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from flags left join told using (doc_id) group by part, mask
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
  select filter_order, k::integer as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::integer as earlier from orders, unnest([1, 2, 3, 4, 5]) as t(k)
), found as (
  select part, filter_order, step, bit,
         coalesce(sum(n) filter (where mask & (earlier | bit) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (where mask & bit > 0 and mask & earlier = 0), 0)::bigint as removed,
         coalesce(sum(n) filter (where mask & bit > 0 and mask & earlier > 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where mask & bit > 0 and mask & earlier = 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where mask & bit > 0 and mask & earlier = 0), 0)::bigint as toxic_lost
  from cells, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley from found
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {str(i < len(licenses.BASE)).lower()}, '{text}')" for i, (label, text) in enumerate([*licenses.BASE, *licenses.NOTICES]))
LICENSES = (
    r"""
with docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), named as (select tid, label, is_base, string_split(t, ' ') as w from (values """
    + _TEMPLATES
    + f""") as v(tid, label, is_base, t)),
grams as (
  select tid, label, is_base, len(w) as size, least(len(w), 3) as k, i as t_at, array_to_string(w[i + 1:i + least(len(w), 3)], ' ') as gram
  from (select *, unnest(range(len(w) - least(len(w), 3) + 1)) as i from named)
), worded as (
  select rid, place, w0, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2
  from (select rid, unnest(range(len(w))) as place, unnest(w) as w0 from docs) window o as (partition by rid order by place)
), places as (
  select rid, place, 2 as k, w0 || ' ' || w1 as gram from worded where w1 is not null union all select rid, place, 3, w0 || ' ' || w1 || ' ' || w2 from worded where w2 is not null
), lines as (
  select rid, tid, label, is_base, size, g.k, place - t_at as diagonal, list(t_at) as hits, min(place) as start, max(place) + g.k as stop
  from places p join grams g on p.gram = g.gram and p.k = g.k group by rid, tid, label, is_base, size, g.k, diagonal
), marked as (
  select *, case when is_base or coalesce(diagonal - lag(diagonal) over (partition by rid, tid order by diagonal), 1000) > {licenses.SLACK} then 1 else 0 end as fresh from lines
), nth as (select *, sum(fresh) over (partition by rid, tid order by diagonal) as nth from marked),
spans as (
  select rid, label, is_base, min(start) as start,
         len(list_distinct(flatten(list_transform(flatten(list(hits)), lambda t: range(t, t + k))))) / size::double as cover, max(stop) - min(start) as long, size
  from nth group by rid, tid, label, is_base, size, k, nth
), good as (select * from spans where is_base or (cover >= {licenses.COVER} and long <= {licenses.STRETCH} * size)),
told as (
  select rid, count(*) filter (where is_base) as n_base, min(start) filter (where is_base) as first_word, max(start) filter (where is_base) as last_word,
         string_agg(distinct label, ',' order by label) filter (where is_base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover) as score
  from good group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs left join told using (rid)
"""
)
