"""DuckDB SQL of the operators whose rows are digests: prefix trie, manifest, fingerprints."""

from __future__ import annotations

from talkgrain.llm.sketches import DIGITS, WIDTH, K

#: Fixed values of CRC-32 (polynomial) and XXH64 (primes), stated by their definitions.
POLYNOMIAL = 0xEDB88320
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
FULL = (1 << 64) - 1


def crc32(text: str) -> str:
    """The CRC-32 of a text, bit by bit over its bytes."""
    byte = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), " \
           f"lambda r, z: xor(r >> 1, {POLYNOMIAL} * (r & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: {bits}), 4294967295)"


def _spread(rows: str, seed: str, value: str, out: str) -> str:
    """``rows`` with ``out``, the XXH64 of a long: one step a level, as each names the last twice."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)

    def turned(x: str, n: int) -> str:
        return f"((({x} << {n}) | ({x} >> {64 - n})) & {FULL}::uhugeint)"

    def times(x: str, p: str) -> str:
        return f"(({x} * {p}) & {FULL}::uhugeint)"

    steps = [times(value, p2), times(turned("s", 31), p1), f"xor(({seed} + {p5} + 8) & {FULL}::uhugeint, s)",
             f"(({turned('s', 27)} * {p1} + {p4}) & {FULL}::uhugeint)", times("xor(s, s >> 33)", p2),
             times("xor(s, s >> 29)", p3), "xor(s, s >> 32)"]
    for k, step in enumerate(steps):
        hidden = "" if k == 0 else " exclude (s)"
        rows = f"(select *{hidden}, {step} as s from {rows})"
    return f"(select * exclude (s), case when {value} is null then {seed} else s end as {out} from {rows})"


_CODES = "(select *, 42::uhugeint as h0 from coded)"
for _k in range(WIDTH):
    _CODES = _spread(_CODES, f"h{_k}", f"c{_k}", f"h{_k + 1}")

FINGERPRINTS = rf"""
with t as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as place, count(*) over () as size
  from documents
), e as (
  select t.doc_id, t.place, t.text as own, length(t.text) as n_chars, n.place as next_place,
    left(t.text, length(t.text) - length(t.text) // 2) || left(n.text, length(t.text) // 2) as edited
  from t join t n on n.place = t.place % t.size + 1
), texts as (
  select place, own as text from e union all select -place, edited from e
), words as (
  select place, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select place, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from texts)
), codes as (
  select word, ({crc32('word')})::uhugeint as c from (select distinct word from words)
), coded as (
  select place, i, c as c0, {', '.join(f"lead(c, {k}) over line as c{k}" for k in range(1, WIDTH))}
  from words join codes using (word)
  window line as (partition by place order by i)
), shingles as (
  select distinct place, lpad(lower(to_hex((h{WIDTH} >> 16)::ubigint)), {DIGITS}, '0') as h
  from {_CODES} where c{WIDTH - 1} is not null or i = 1
), sketched as (
  select place, list_sort(list(h)) as every, len(every) < {K} as complete, every[1:{K}] as h from shingles group by place
), prints as (
  select texts.place, coalesce(h, []::varchar[]) as h, coalesce(complete, true) as complete
  from texts left join sketched using (place)
), pairs as (
  select e.*, a.h as ha, b.h as hb, array_to_string(a.h, '') as fingerprint, array_to_string(b.h, '') as edited_fingerprint,
    list_sort(list_distinct(a.h || b.h)) as ub, list_sort(list_distinct(a.h || c.h)) as uc,
    case when a.complete and b.complete then ub else ub[1:{K}] end as wb,
    case when a.complete and c.complete then uc else uc[1:{K}] end as wc,
    list_intersect(list_intersect(a.h, b.h), wb) as bb, list_intersect(list_intersect(a.h, c.h), wc) as bc
  from e join prints a on a.place = e.place join prints b on b.place = -e.place join prints c on c.place = e.next_place
)
select doc_id, n_chars::bigint as n_chars, sha256(edited) as edited_sha256, fingerprint, edited_fingerprint,
  case when len(wb) = 0 then 1.0::double else len(bb)::double / len(wb) end as near_edited,
  case when len(wc) = 0 then 1.0::double else len(bc)::double / len(wc) end as near_next
from pairs
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || ({value}::varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str, leaves: str) -> str:
    """Every node of the trees over ``leaves`` (tree, pos, h): level by level, n nodes on each."""
    return f"""{name}(tree, level, pos, h, n) as (
  select tree, 0, pos, h, count(*) over (partition by tree) from {leaves}
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), any_value((n + 2) // 3)
  from {name} where n > 1 group by tree, level, pos // 3
)"""


def _steps(name: str, leaves: str, nodes: str) -> str:
    """What stands left and right of each leaf's ancestors, as texts with a bar, bottom to top."""
    return f"""{name} as (
  select tree, pos, list(step order by level) as steps from (
    select l.tree, l.pos, v.level,
      coalesce(string_agg(v.h, '' order by v.pos) filter (v.pos < l.pos // (3 ** v.level)::bigint), '') || '|'
        || coalesce(string_agg(v.h, '' order by v.pos) filter (v.pos > l.pos // (3 ** v.level)::bigint), '') as step
    from {leaves} l join {nodes} v on v.tree = l.tree and v.n > 1 and v.pos // 3 = l.pos // (3 ** (v.level + 1))::bigint
    group by all)
  group by tree, pos
)"""


MANIFEST = f"""
with recursive leaves as (
  select coalesce('=' || source, '') as tree, doc_id, {_leaf('text')} as h,
    case when ({crc32('doc_id::varchar')}) % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else h end as given,
    row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos
  from documents
), {_levels('low', 'leaves')}, tops as (
  select '' as tree, tree as name, h, row_number() over (order by tree) - 1 as pos from low where n = 1
), {_levels('high', 'tops')}, {_steps('low_steps', 'leaves', 'low')}, {_steps('high_steps', 'tops', 'high')},
proofs as (
  select l.doc_id, l.h as leaf, l.given, t.h as subroot, r.h as root,
    coalesce(a.steps, []::varchar[]) || coalesce(b.steps, []::varchar[]) as steps
  from leaves l join tops t on t.name = l.tree join high r on r.n = 1
  left join low_steps a on a.tree = l.tree and a.pos = l.pos left join high_steps b on b.pos = t.pos
)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256,
  list_reduce(list_prepend(given, steps), lambda c, s: sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2)))
    as folded_root, folded_root = root as verified
from proofs
"""

TRIE = f"""
with turns as (
  select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as h,
    strlen(coalesce(text, '')) as bytes,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id as c, conv_id - conv_id % 5 as family, ({crc32('conv_id::varchar')}) % 9 as h from turns group by conv_id
), leads as (
  select c, convs.h, (select count(*) from turns where conv_id = family) as lead, family from convs
), built as (
  select c, pos as place, t.h, bytes from leads join turns t on t.conv_id = family where pos < leads.h
  union all
  select c, least(leads.h, lead) + pos - leads.h, t.h, bytes from leads join turns t on t.conv_id = c where pos >= leads.h
), paths as (
  select c, place + 1 as depth, bytes, string_agg(h, '') over (partition by c order by place) as key from built
  union all select c, 0, 0, '' from convs
), ends as (
  select c, max(depth) as depth from paths group by c
), nodes as (
  select key, p.depth, min(c) as conv_id, count(*) as n, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (e.depth = p.depth), '')) as ends_sha256
  from paths p join ends e using (c) group by key, p.depth
), linked as (
  select v.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = v.depth + 1
    and left(k.key, 64 * v.depth::int) = v.key) as n_children
  from nodes v left join nodes p on p.depth = v.depth - 1 and left(v.key, 64 * p.depth::int) = p.key
)
select v.conv_id, v.depth::bigint as depth, v.parent_conv_id, v.n::bigint as n_convs, v.n_children::bigint as n_children,
  count(*) filter (u.n_children = 0)::bigint as n_leaves, sum((u.n - 1) * u.bytes)::bigint as saved_tokens, v.ends_sha256
from linked v join linked u on u.depth >= v.depth and left(u.key, 64 * v.depth::int) = v.key
group by all
"""

DIGESTS = {"op11_prefix_trie": TRIE, "op12_merkle_manifest": MANIFEST, "op13_fingerprints": FINGERPRINTS}
