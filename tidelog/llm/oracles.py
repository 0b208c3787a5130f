"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

WORD_COUNT = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(k || ':{name}'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / {float(weight)!r}::double"


def _won(names: list[tuple[str, int]]) -> str:
    """The place of the least draw, from 0."""
    draws = [_draw(*x) for x in names]
    return f"(list_position([{', '.join(draws)}], least({', '.join(draws)})) - 1)"


def _tree(regions: dict[str, int]) -> str:
    """Shard of the key k in a tree of 2 regions x 3 racks x 4 shards, and shards from 24 on alone in regions."""
    out = f"(case {_won(list(regions.items()))}"
    for r, name in enumerate(regions):
        if r > 1:
            out += f" when {r} then {22 + r}"
            continue
        out += f" when {r} then {12 * r} + (case {_won([(f'{name}/k{k}', 4) for k in range(3)])}"
        for k in range(3):
            out += f" when {k} then {4 * k} + {_won([(f'{name}/k{k}/{12 * r + 4 * k + i}', 1) for i in range(4)])}"
        out += " end)"
    return out + " end)::int"


OP6 = f"""
with tab as (select list(list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) t from range(256) r(i)),
d as (select doc_id, coalesce(doc_id::varchar, 'null') k, coalesce(text, '') x from documents),
put as (select doc_id, k, (strlen(x) + 8)::bigint size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(x) + 1), lambda i: ('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::bigint)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::bigint text_crc32,
  {_tree({"/g0": 12, "/g1": 12})} shard, {_tree({"/g0": 12, "/g1": 12, "/x0": 1})} grown_shard from d, tab)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by substr(md5(k), 1, 3), doc_id, size, text_crc32) - 1 slot, grown_shard from put
"""

OP8 = f"""
with d as (select doc_id, source, {WORD_COUNT}::bigint size, md5('mix:' || coalesce(doc_id::varchar, 'null')) k from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
v as (select *, ([3, 1, 2])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double w, 2::double * source_size t from s),
u as (select *, sum(source_size) over () * 1.5::double total, sum(w) over () all_w,
  coalesce(sum(t) over (order by t / w, source is null, source rows between unbounded preceding and 1 preceding), 0) b,
  coalesce(sum(w) over (order by t / w, source is null, source rows between unbounded preceding and 1 preceding), 0) bw from v),
l as (select *, max(case when (total - b) / (all_w - bw) * w <= t then (total - b) / (all_w - bw) end) over () rest from u),
g as (select source, source_size, case when rest is null then t else least(t, rest * w) end target from l),
r as (select d.*, g.source_size, g.target, floor(target + 1e-6)::bigint budget, sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and current row) - size before
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (case when source_size > 0 then budget // source_size * size + greatest(0, least(size, budget % source_size - before)) else 0 end)::bigint taken from r
"""

OP10 = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
u as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
p as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id a, vec_id c from v union select p.a, r.c from p join r on p.b = r.a),
m as (select a, min(c) c from r group by a),
n as (select a, count(*) n from p group by a)
select v.vec_id, coalesce(n.n, 0)::bigint n_links, m.c component_id, v.vec_id = m.c kept from v left join m on v.vec_id = m.a left join n on v.vec_id = n.a
"""

OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, k, substr(h, 2 * k + 1, 100) s from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) k from d)),
m as (select s, min(doc_id) f from w group by s),
g as (select w.doc_id, w.k from w join m on w.s = m.s where m.f < w.doc_id),
n as (select doc_id, k, case when k <= lag(k) over (partition by doc_id order by k) + 50 then 0 else 1 end b from g),
r as (select doc_id, k, sum(b) over (partition by doc_id order by k) i from n),
p as (select doc_id, min(k) a, max(k) + 50 z from r group by doc_id, i),
c as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) s, a e from p union all select doc_id, max(z), null from p group by doc_id),
t as (select d.doc_id, string_agg(case when e is null then substr(h, 2 * s + 1) else substr(h, 2 * s + 1, 2 * (e - s)) end, '' order by s) h from d join c on d.doc_id = c.doc_id group by d.doc_id),
q as (select doc_id, sum(z - a)::bigint removed, count(*) spans from p group by doc_id)
select d.doc_id, length(d.h) // 2 n_bytes, coalesce(removed, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(t.h, d.h))) kept_sha256
from d left join t on d.doc_id = t.doc_id left join q on d.doc_id = q.doc_id
"""

OP5 = """
with recursive t as (select distinct conv_id, coalesce(turn, -1) turn, role, coalesce(text, '') x from conversations),
u as (select distinct conv_id, turn from t where role = 'user'),
k as (select t.*, case when role = 'user' then 'call' when role = 'assistant' and u.turn is not null then 'result' else coalesce(role, 'unknown') end kind,
  ((coalesce(t.conv_id, 0) * 7 + t.turn) % 12 + 12) % 12 rule from t left join u on t.conv_id is not distinct from u.conv_id and t.turn = u.turn + 1),
r as (select distinct conv_id, turn from k where kind = 'result'),
j as (select k.*, r.turn answered, case kind when 'call' then 'call_' || k.turn when 'result' then 'call_' || (k.turn - 1) end call_id,
  case rule when 0 then null when 5 then null when 7 then null when 2 then k.turn + 2 when 4 then k.turn - 4 when 6 then k.turn + 2 when 8 then k.turn + 4 when 9 then k.turn + 2 when 10 then k.turn when 11 then k.turn - 4 else k.turn - 2 end named
  from k left join r on kind = 'call' and k.conv_id is not distinct from r.conv_id and r.turn = k.turn + 1),
e as (select a.conv_id, a.turn c, d.turn d, d.answered dres from j a join j d on a.conv_id is not distinct from d.conv_id and a.kind = 'call' and d.kind = 'call' and a.named = d.turn and d.turn >= 0 and d.answered is not null),
far as (select conv_id, c, d from e union select far.conv_id, far.c, e.d from far join e on far.conv_id is not distinct from e.conv_id and far.d = e.c),
cyc as (select distinct f.conv_id, f.c from far f join far z on f.conv_id is not distinct from z.conv_id and f.d = z.c and z.c = z.d),
lp as (select conv_id, turn c, turn s, 0 l from j where kind = 'call'
  union select e.conv_id, e.c, greatest(lp.s, e.dres), case when e.dres > lp.s then 1 else lp.l + 2 end from lp join e on lp.conv_id is not distinct from e.conv_id and lp.c = e.d
  where greatest(lp.s, e.dres) >= e.c and not exists (select 1 from cyc where cyc.conv_id is not distinct from e.conv_id and cyc.c = e.c)),
spot as (select conv_id, c, m.s, m.l, w from (select lp.conv_id, lp.c, max({'s': s, 'l': l}) m, bool_or(cyc.c is not null) w from lp left join cyc on lp.conv_id is not distinct from cyc.conv_id and lp.c = cyc.c group by lp.conv_id, lp.c)),
v as (select j.*, spot.s, spot.l, spot.w, case rule when 0 then 'extra:.tone' when 1 then 'missing:.prompt' when 3 then 'type:.prompt' when 5 then 'unknown_tool' when 7 then 'bad_json' else 'ok' end valid,
  case when w then 'cycle' when answered is null then 'no_result' else 'ok' end state,
  case rule when 7 then '{"prompt":' else '{' || concat_ws(',', case when named >= 0 then '"after":"$result:call_' || named || '"' end, case rule when 1 then null when 3 then '"prompt":' || j.turn else '"prompt":' || to_json(x) end, case when rule = 0 then '"tone":1' end) || '}' end args
  from j left join spot on j.conv_id is not distinct from spot.conv_id and spot.c = case kind when 'call' then j.turn when 'result' then j.turn - 1 end)
select conv_id, turn, kind, call_id, (case kind when 'call' then answered when 'result' then turn - 1 end)::bigint linked_turn,
  case when kind <> 'call' then 'ok' when valid = 'ok' then state when state = 'ok' then valid else state || ',' || valid end status,
  case kind when 'call' then s when 'result' then greatest(turn, s) else turn end slot, (case when kind = 'call' then l when kind = 'result' and turn <= s then l + 1 else 0 end)::int as level,
  case kind when 'call' then '{"role":"assistant","tool_calls":[{"function":{"arguments":' || to_json(args) || ',"name":"' || case when rule = 5 then 'answer' else 'reply' end || '"},"id":"' || call_id || '","type":"function"}]}'
    when 'result' then '{"content":' || to_json(x) || ',"role":"tool","tool_call_id":"' || call_id || '"}'
    else '{"content":' || to_json(x) || ',"role":' || to_json(kind) || '}' end as json from v
"""

ORACLE_SQL: dict[str, str] = {"op2_bwt_substring_dedup": OP2, "op5_tool_call_linking": OP5, "op6_hash_tree_sharding": OP6, "op8_source_mixing": OP8, "op10_pstable_lsh": OP10}
