"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from talkgrain.llm.decontam import MASKS, PERCENT, SHORTEST, SPAN
from talkgrain.llm.oracle_digests import DIGESTS

MIXING = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as place
  from documents
), ranked as (
  select source, sum(size)::bigint as source_size,
    row_number() over (order by source asc nulls last) as rank
  from sizes group by source
), caps as (
  select *, 3 * source_size as cap,
    case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight
  from ranked
), levels as (
  select *,
    sum(source_size) over ()::bigint - (sum(cap) over upto - cap)::bigint as words_left,
    sum(weight) over (order by cap * (10 // weight), rank
      rows between current row and unbounded following)::bigint as weight_left
  from caps
  window upto as (order by cap * (10 // weight), rank rows between unbounded preceding and current row)
), marked as (
  select *, cap * weight_left <= weight * words_left as stops,
  from levels
), share as (
  select words_left as s_left, weight_left as s_by from marked where not stops
  order by cap * (10 // weight), rank limit 1
), targets as (
  select source, source_size,
    case when stops then cap::double else (weight * s_left)::double / s_by end as target,
    case when stops then cap else (2 * weight * s_left + s_by) // (2 * s_by) end as want
  from marked left join share on true
), line as (
  select s.*, t.source_size, t.target, t.want, (sum(size) over (
    partition by s.source order by place, doc_id, size
    rows between unbounded preceding and current row) - size)::bigint as a
  from sizes s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when size = 0 then 0 else (want // source_size) * size
    + greatest(0, least(a + size, want % source_size) - a) end)::bigint as taken,
  source
from line
"""
def _picked(mask: tuple[int, ...]) -> str:
    return "[" + ", ".join(f"w[i + {o + 1}]" for o in mask) + "]"


DECONTAMINATION = r"""
with d as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), b as (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w
  from benchmark where item_id is not null
), dp as (
  select doc_id, w, unnest(range(0, len(w) - SPAN + 1)) as i from d where len(w) >= SPAN
), bp as (
  select item_id, w, unnest(range(0, len(w) - SPAN + 1)) as i from b where len(w) >= SPAN
), ds as (DSEEDS), bs as (BSEEDS), met as (
  select distinct doc_id, item_id, ds.i - bs.i as shift, bs.i as place
  from ds join bs using (mask, seed)
), stretches as (
  select p.doc_id, p.item_id, p.shift, p.place as low, q.place + SPAN as high
  from met p join met q using (doc_id, item_id, shift) where p.place <= q.place
), judged as (
  select doc_id, item_id, high - low as width,
    len(list_filter(range(low, high), lambda t: b.w[t + 1] = d.w[t + shift + 1])) as matched
  from stretches join d using (doc_id) join b using (item_id)
), short as (
  select item_id, w, len(w) as n from b where len(w) between SHORTEST and SPAN - 1
), windows as (
  select distinct doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) as part
  from d, (select distinct n from short) where len(w) >= n
), found as (
  select doc_id, item_id, max(matched) as matched from (
    select doc_id, item_id, matched from judged where 100 * matched >= PERCENT * width
    union all
    select doc_id, item_id, short.n from windows join short on part = w
  ) group by all
), per_doc as (
  select doc_id, count(*) as n_items, max(matched) as matched, min(item_id) as first_item
  from found group by doc_id
)
select doc_id, coalesce(n_items, 0)::bigint as n_items, coalesce(matched, 0)::bigint as matched,
  coalesce(first_item, -1)::bigint as first_item, n_items is not null as contaminated
from documents left join per_doc using (doc_id)
"""
for _name, _from, _key in (("DSEEDS", "dp", "doc_id"), ("BSEEDS", "bp", "item_id")):
    DECONTAMINATION = DECONTAMINATION.replace(_name, " union all ".join(
        f"select {_key}, {k} as mask, {_picked(m)} as seed, i from {_from}" for k, m in enumerate(MASKS)))
DECONTAMINATION = DECONTAMINATION.replace("SPAN", str(SPAN)).replace("PERCENT", str(PERCENT)).replace(
    "SHORTEST", str(SHORTEST))

LLM_ORACLE = {"op3_mixing": MIXING, "op9_decontamination": DECONTAMINATION, **DIGESTS}
