"""DuckDB SQL for the same queries, written apart from them."""

from __future__ import annotations

WRITE_LOG = """wl as (select event_type file_id, user_id pid, event_id seq, event_id * 7919 % 1000003 logical_offset,
 coalesce(sum(1 + cast(floor(value * 10) as bigint)) over (partition by event_type, user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint physical_offset,
 1 + cast(floor(value * 10) as bigint) length, epoch_us(ts) begin_us, epoch_us(ts) + 1 + event_id % 997 end_us from events)"""


def _resolved(source: str = "wl") -> str:
    return f"""pts as (select file_id, logical_offset p from {source} where length > 0 union select file_id, logical_offset + length from {source} where length > 0),
seg as (select file_id, p lo, lead(p) over (partition by file_id order by p) hi from pts),
win as (select s.file_id, s.lo, s.hi, l.pid, l.seq, l.physical_offset, l.begin_us, l.end_us, l.logical_offset,
  row_number() over (partition by s.file_id, s.lo order by l.end_us desc, l.begin_us desc, l.pid desc, l.seq desc) rn
  from seg s join {source} l on s.file_id = l.file_id and l.logical_offset <= s.lo and s.lo < l.logical_offset + l.length where s.hi is not null),
mk as (select *, case when lag(hi) over (partition by file_id, pid, seq order by lo) = lo then 0 else 1 end nw from win where rn = 1),
gr as (select *, sum(nw) over (partition by file_id, pid, seq order by lo rows unbounded preceding) g from mk),
ext as (select file_id, min(lo) logical_offset, max(hi) - min(lo) length, pid, seq, min(physical_offset + lo - logical_offset) physical_offset, begin_us, end_us
  from gr group by file_id, pid, seq, g, begin_us, end_us)"""


EXT = f"with {WRITE_LOG}, {_resolved()}"
HOLES = """hl as (select file_id, e hole_offset, n - e hole_length from (select file_id, logical_offset + length e, lead(logical_offset) over (partition by file_id order by logical_offset) n from ext) where n > e
  union all select file_id, 0, min(logical_offset) from ext group by file_id having min(logical_offset) > 0)"""
PROBES = "pr as (select event_id probe_id, event_type file_id, event_id * 104729 % 1010000 \"offset\", 1 + event_id % 5000 length from events)"
FULL = f"""{HOLES}, eo as (select file_id, max(logical_offset + length) eof from wl group by file_id),
cm as (select file_id, false hole, logical_offset, length, pid, physical_offset from ext union all select file_id, true, hole_offset, hole_length, null, null from hl
  union all select eo.file_id, true, m, eof - m, null, null from eo join (select file_id, max(logical_offset + length) m from ext group by file_id) x on eo.file_id = x.file_id where eof > m)"""
RANGE = f"""{FULL}, {PROBES},
rq as (select probe_id, c.file_id, hole, greatest(c.logical_offset, "offset") logical_offset, least(c.logical_offset + c.length, "offset" + p.length) - greatest(c.logical_offset, "offset") length, pid,
  physical_offset + greatest(c.logical_offset, "offset") - c.logical_offset chunk_offset from cm c join pr p on c.file_id = p.file_id and c.logical_offset < "offset" + p.length and "offset" < c.logical_offset + c.length)"""
NAME_LOG = """nl as (select o_orderpriority dir_id, o_orderkey % 8 did, o_orderkey * 32 rec_off, o_orderkey seq, epoch_us(o_orderdate) + o_orderkey ts_us,
 case when o_orderkey % 10 < 4 then 1 when o_orderkey % 10 < 7 then 3 when o_orderkey % 10 = 7 then 5 when o_orderkey % 10 = 8 then 2 else 4 end op,
 concat('f', cast(o_custkey % 500 as varchar)) name, case when o_orderkey % 10 = 9 then concat('f', cast((o_custkey + 1) % 500 as varchar)) end name_to from orders)"""
SMALL = """si as (select l_suppkey % 8 did, l_orderkey % 200 fid, seq, l_partkey * 64 % 65536 off, case when seq % 41 = 0 then 0 else cast(l_quantity as bigint) * 16 end length,
 epoch_us(l_shipdate) + seq ts_us, case when seq % 41 = 0 then -1 else seq * 1024 end physical_offset from
 (select *, cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) seq from lineitem) t),
lc as (select *, min(case when physical_offset = -1 then off end) over (partition by fid order by ts_us, did, seq rows between 1 following and unbounded following) cut from si),
cl as (select did, fid, seq, off, ts_us, physical_offset, least(off + length, coalesce(cut, off + length)) - off length from lc where physical_offset <> -1 and length > 0)"""
SMALL_EXT = f"""with {SMALL}, k as (select * from cl where length > 0), pts as (select fid, off p from k union select fid, off + length from k), seg as (select fid, p lo, lead(p) over (partition by fid order by p) hi from pts),
win as (select s.fid, s.lo, s.hi, k.did, k.seq, k.off, k.physical_offset, row_number() over (partition by s.fid, s.lo order by k.ts_us desc, k.did desc, k.seq desc) rn from seg s join k on s.fid = k.fid and k.off <= s.lo and s.lo < k.off + k.length where s.hi is not null),
mk as (select *, case when lag(hi) over (partition by fid, did, seq order by lo) = lo then 0 else 1 end nw from win where rn = 1), gr as (select *, sum(nw) over (partition by fid, did, seq order by lo rows unbounded preceding) g from mk),
ext as (select fid, min(lo) off, max(hi) - min(lo) length, did, seq, min(physical_offset + lo - off) physical_offset from gr group by fid, did, seq, g)"""
#: The fold over a directory's records in time order, a step for each; cur has the names at its end.
REPLAY = f"""recursive {NAME_LOG}, od as (select *, row_number() over (partition by dir_id order by ts_us, did, seq) k from nl), tops as (select dir_id, max(k) top from od group by dir_id),
st as (select dir_id, 0::bigint k, []::struct(n varchar, t bigint, o struct(fid bigint, did bigint)[])[] s from tops
  union all select od.dir_id, od.k, case
    when op = 1 then case when len(list_filter(s, lambda x: x.n = name)) > 0 then s else list_append(s, {{'n': name, 't': ts_us, 'o': []}}) end
    when op = 2 then list_filter(s, lambda x: x.n <> name)
    when op = 3 then list_transform(s, lambda x: case when x.n = name then {{'n': x.n, 't': ts_us, 'o': list_append(x.o, {{'fid': rec_off, 'did': od.did}})}} else x end)
    when op = 5 then list_transform(s, lambda x: case when x.n = name then {{'n': x.n, 't': ts_us, 'o': x.o}} else x end)
    when len(list_filter(s, lambda x: x.n = name)) = 0 then s
    else list_transform(list_filter(s, lambda x: x.n = name or x.n <> name_to), lambda x: case when x.n = name then {{'n': name_to, 't': x.t, 'o': x.o}} else x end) end
  from st join od on st.dir_id = od.dir_id and od.k = st.k + 1),
cur as (select dir_id, u.n, u.t, u.o from (select st.dir_id, unnest(s) u from st join tops on st.dir_id = tops.dir_id and st.k = tops.top))"""
LINKS = """lk as (select path, concat('/store/v', v, '/', substr(path, strip + 1)) target from (select concat('/mnt/b', c_custkey % 13, '/dir/l', c_custkey) path, length(concat('/mnt/b', c_custkey % 13)) strip, c_custkey % 5 v from customer) where v < 4)"""
MESSAGES = "ms as (select event_id, event_type facility, (65536 << (event_id % 7)::int)::int as level, case event_type when 'click' then 1048576 when 'error' then 327680 when 'view' then 4194304 end mask from events)"
LET_THROUGH = "case when level >= 1048576 then level >= mask else (level & mask) <> 0 end"
LINES = """ln as (select case when event_id % 11 = 0 then concat('12:00 host', event_id % 9, '.site tag') when event_id % 13 = 0 then concat('x host.site tag ', event_type, ' INFO  gone ', event_id) else concat('12:', event_id % 60, '  host', event_id % 9, '.site.org tag', event_id % 3, ' ', event_type, ' WARN text of  ', event_id) end as value,
 case when event_id % 11 <> 0 then case when event_id % 13 = 0 then 'x' else concat('12:', event_id % 60) end end date, case when event_id % 11 <> 0 then case when event_id % 13 = 0 then 'host.site' else concat('host', event_id % 9, '.site.org') end end host,
 case when event_id % 11 <> 0 then case when event_id % 13 = 0 then 'tag' else concat('tag', event_id % 3) end end tag, case when event_id % 11 <> 0 then event_type end facility, case when event_id % 11 <> 0 then case when event_id % 13 = 0 then 'INFO' else 'WARN' end end as level,
 case when event_id % 11 <> 0 then case when event_id % 13 = 0 then concat('gone ', event_id) else concat('text of  ', event_id) end end message, case when event_id % 11 = 0 then 'parse' when event_id % 13 = 0 then 'invalid' end error from events)"""
META = """mt as (select concat('c', cast(o_custkey % 300 as varchar)) file_id, concat('host', cast(o_orderkey % 40 as varchar)) host, cast(floor(o_totalprice * 100) as bigint) last_offset, cast(floor(o_totalprice * 130) as bigint) total_bytes, epoch_us(o_orderdate) close_us from orders)"""
HANDLES = "oh as (select distinct concat('c', cast(c_custkey % 300 as varchar)) file_id, concat('host', cast(c_custkey % 40 as varchar)) host, c_custkey % 97 pid from customer where c_custkey % 13 = 0)"
HOST_LOGS = "lg as (select concat('c', cast(o_custkey % 300 as varchar)) file_id, concat('host', cast(o_orderkey % 43 as varchar)) host, o_orderkey * 512 logical_offset, 1 + o_orderkey % 9000 length, epoch_us(o_orderdate) end_us from orders)"
TRACE = "tr as (select user_id pid, event_id seq, event_id * 4096 logical_offset, 1 + cast(floor(value * 1000) as bigint) length, epoch_us(ts) begin_us, epoch_us(ts) + (1 + event_id % 997) * 60000000 end_us from events)"
ENDS = f"with {TRACE}, we as (select pid, max(end_us) end_us from tr group by pid)"
SPREAD = f"""with {TRACE}, sp as (select min(begin_us) z, max(end_us) - min(begin_us) span from tr where begin_us < end_us),
b as (select tr.*, span, ((begin_us - z) * 500) // span first_bin, ((end_us - begin_us) * 500 + span - 1) // span spanned from tr, sp where begin_us < end_us), bins as (select range bin from range(500))"""
COVER = "c as (select *, unnest(range(least(first_bin, 499), least(first_bin + spanned - 1, 499) + 1)) bin from b)"
STAT = "select file_id, max(last_offset) size, sum((total_bytes + 511) // 512)::bigint blocks, max(close_us // 1000000) mtime_s"
HIST = "select range bucket, coalesce(n, 0)::bigint records from range(51) left join (select {} k, count(*) n from tr group by 1) on k = range"


def _bandwidth(extra: str = "") -> str:
    return f"{SPREAD}, {COVER} select bins.bin, coalesce(round(sum(length / ((end_us - begin_us) / 1e6::double) / 1048576::double{extra}), 4), 0) mib_s from bins left join c on bins.bin = c.bin group by bins.bin"


def _stragglers(select: str) -> str:
    return f"{ENDS}, st as (select avg(end_us) m, stddev_pop(end_us) s, count(*) n from we), sd as (select pid, end_us, case when end_us > m + case when n <= 16 then 0 else s end then 'above' when end_us < m - case when n <= 16 then 0 else s end then 'below' end side, n from we, st) {select}"


#: The sections of a report, each as it is computed on its own.
REPORT = f"""{SPREAD}, {COVER}, we as (select pid, max(end_us) end_us from tr group by pid), st as (select avg(end_us) m, stddev_pop(end_us) s, count(*) n from we),
ab as (select count(*) filter (end_us > m + case when n <= 16 then 0 else s end) up, count(*) filter (end_us < m - case when n <= 16 then 0 else s end) down from we, st),
hd as (select [500::double, min(begin_us) / 1e6::double, (select sum(end_us)::bigint / count(*) / 1e6::double from we), (max(end_us) - min(begin_us)) / 500 / 1e6::double, (select up from ab)::double, (select down from ab)::double] v from tr),
rp as (select 'head' section, i::int idx, v[i + 1] as "value" from hd, range(6) r(i)
  union all select 'bandwidth', bins.bin::int, coalesce(round(sum(length / ((end_us - begin_us) / 1e6::double) / 1048576::double), 4), 0) from bins left join c on bins.bin = c.bin group by bins.bin
  union all select 'running', bins.bin::int, (select count(*) from b where bins.bin >= first_bin and bins.bin < first_bin + spanned - 1)::double from bins
  union all select 'finished', bins.bin::int, count(b.seq)::double from bins left join b on least(first_bin + spanned - 1, 499) = bins.bin group by bins.bin
  union all select 'sizes', range::int, coalesce(n, 0)::double from range(51) left join (select case when length < 2 then 0 else least(length(bin(length)) - 1, 50) end k, count(*) n from tr group by 1) on k = range)"""
UNIT = "case when bytes >= 1125899906842624 then 5 when bytes >= 1099511627776 then 4 when bytes >= 1073741824 then 3 when bytes >= 1048576 then 2 when bytes >= 1024 then 1 else 0 end"

ORACLE_SQL: dict[str, str] = {
    "resolve_extents": f"{EXT} select * from ext",
    "merge_logs": f"{EXT} select * from ext",
    "physical_offset": f"with {WRITE_LOG} select file_id, pid, seq, length, physical_offset from wl",
    "file_stats": f"with {WRITE_LOG} select file_id, max(logical_offset + length) eof, sum(length)::bigint backing_bytes, count(*) records from wl group by file_id",
    "uniform_restart": f"with {WRITE_LOG}, one as (select * from wl where pid = 7), {_resolved('one')} select * from ext",
    "holes": f"{EXT}, {HOLES} select * from hl",
    "coalesce": f"""{EXT}, m as (select *, case when lag(logical_offset + length) over w = logical_offset and lag(physical_offset + length) over w = physical_offset then 0 else 1 end nw from ext window w as (partition by file_id, pid, logical_offset - physical_offset order by logical_offset)),
n as (select *, sum(nw) over (partition by file_id, pid, logical_offset - physical_offset order by logical_offset rows unbounded preceding) g from m)
select file_id, pid, min(logical_offset) logical_offset, sum(length)::bigint length, min(physical_offset) physical_offset, min(begin_us) begin_us, max(end_us) end_us, count(*) pieces from n group by file_id, pid, logical_offset - physical_offset, g""",
    "contiguous_writes": f"""with {WRITE_LOG}, m as (select *, case when lag(logical_offset + length) over (partition by file_id, pid order by seq) = logical_offset then 0 else 1 end nw from wl),
n as (select *, sum(nw) over (partition by file_id, pid order by seq rows unbounded preceding) g from m)
select file_id, pid, min(logical_offset) logical_offset, sum(length)::bigint length, min(physical_offset) physical_offset, min(begin_us) begin_us, max(end_us) end_us, count(*) records from n group by file_id, pid, g""",
    "overlaps": f"with {WRITE_LOG} select a.file_id, a.seq, count(b.seq) overlapping from wl a left join wl b on a.file_id = b.file_id and a.seq <> b.seq and a.logical_offset < b.logical_offset + b.length and b.logical_offset < a.logical_offset + a.length group by a.file_id, a.seq",
    "range_query": f"{EXT}, {RANGE} select *, lead(logical_offset) over (partition by probe_id order by logical_offset) is null last_record from rq",
    "read_tasks": f"""{EXT}, {RANGE}, m as (select *, case when lag(logical_offset + length) over w = logical_offset and lag(hole) over w = hole and (hole or (lag(pid) over w = pid and lag(chunk_offset + length) over w = chunk_offset)) then 0 else 1 end nw from rq window w as (partition by probe_id, file_id order by logical_offset)),
n as (select *, sum(nw) over (partition by probe_id, file_id order by logical_offset rows unbounded preceding) g from m)
select probe_id, file_id, bool_and(hole) hole, min(logical_offset) logical_offset, sum(length)::bigint length, min(pid) pid, min(chunk_offset) chunk_offset, count(*) records from n group by probe_id, file_id, g""",
    "stab_lookup": f"""{EXT}, {FULL}, {PROBES} select probe_id, p.file_id, "offset", case when c.file_id is null then 'eof' when hole then 'hole' else 'data' end state, pid, physical_offset + "offset" - logical_offset chunk_offset, logical_offset + c.length - "offset" run
from pr p left join cm c on p.file_id = c.file_id and c.logical_offset <= "offset" and "offset" < c.logical_offset + c.length""",
    "truncate_extents": f"{EXT} select file_id, logical_offset, least(length, 500000 - logical_offset) length, pid, seq, physical_offset, begin_us, end_us from ext where logical_offset < 500000",
    "data_paths": f"{EXT}, {RANGE} select probe_id, logical_offset, length, hole, chunk_offset, case when hole then null else concat('/store/', file_id, '/dropping.data.', pid) end data_path from rq",
    "rewritten_log": f"with {WRITE_LOG} select file_id, pid, seq, logical_offset, physical_offset, least(length, 500000 - logical_offset) length, begin_us, end_us from wl where logical_offset < 500000",
    "truncate_grow": f"with {WRITE_LOG} select file_id, 2000000::bigint eof, max(logical_offset + length) < 2000000 grown from wl group by file_id",
    "stat_closed": f"with {META}, {HANDLES} {STAT} from mt where not exists (select 1 from oh where oh.file_id = mt.file_id and oh.host = mt.host) group by file_id",
    "stat_size": f"""with {META}, {HANDLES}, {HOST_LOGS}, c as ({STAT} from mt where not exists (select 1 from oh where oh.file_id = mt.file_id and oh.host = mt.host) group by file_id),
r as (select file_id, host, max(logical_offset + length) e, sum(length) b, max(end_us // 1000000) t from lg where exists (select 1 from oh where oh.file_id = lg.file_id and oh.host = lg.host) or not exists (select 1 from mt where mt.file_id = lg.file_id and mt.host = lg.host) group by file_id, host),
u as (select * from c union all select file_id, max(e), sum((b + 511) // 512), max(t) from r group by file_id)
select file_id, max(size)::bigint size, sum(blocks)::bigint blocks, max(mtime_s)::bigint mtime_s from u group by file_id""",
    "lazy_size": f"with {META}, {HOST_LOGS} select s.file_id, greatest(s.size, coalesce(l.eof, 0)) size from (select file_id, max(last_offset) size from mt group by file_id) s left join (select file_id, max(logical_offset * 20 + length) eof from lg group by file_id) l on s.file_id = l.file_id",
    "open_hosts": f"with {HANDLES} select file_id, count(distinct host) hosts, count(*) handles from oh group by file_id",
    "truncate_meta": f"with {META} select file_id, host, least(last_offset, 10000000) last_offset, case when last_offset > 10000000 then 10000000 else total_bytes end total_bytes, close_us from mt",
    "parse_names": f"with {META} select concat(last_offset, '.', total_bytes, '.', close_us // 1000000, '.', close_us % 1000000, '.', host, '.site') name, last_offset, total_bytes, close_us, concat(host, '.site') host from mt",
    "parse_index_names": "select concat('hostdir.', o_orderkey % 32, '/dropping.index.', 1000000 + o_orderkey, '.', o_custkey, '.n', o_custkey % 9, '.cluster.', o_orderkey % 97) name, (1000000 + o_orderkey) * 1000000 + o_custkey timestamp_us, concat('n', o_custkey % 9, '.cluster') host, o_orderkey % 97 pid, concat('hostdir.', o_orderkey % 32, '/dropping.data.', 1000000 + o_orderkey, '.', o_custkey, '.n', o_custkey % 9, '.cluster.', o_orderkey % 97) data_name from orders",
    "parse_open_names": f"with {HANDLES} select distinct concat('open.', host, '.site.', pid) name, concat(host, '.site') host, pid from oh",
    "parse_summaries": "select o_orderkey * 4096 size, o_orderkey * 8 bytes, 1000 + o_custkey open_s, 1001 + o_custkey + o_orderkey % 50 close_s, 'MPI' interface, (1 + o_custkey % 64)::int nproc, concat('n', o_custkey % 9, '.site') host, (o_custkey % 7)::int uid, '_a_b' path, (o_orderkey * 4096)::double / (1 + o_orderkey % 50) / 1048576::double mib_s from orders",
    "container_sizes": "with f as (select concat('c', cast(o_custkey % 300 as varchar)) file_id, o_orderkey % 3 = 0 i, cast(floor(o_totalprice) as bigint) size from orders) select file_id, sum(case when i then 0 else size end)::bigint data_bytes, sum(case when i then size else 0 end)::bigint index_bytes, sum(case when i then size // 48 else 0 end)::bigint records from f group by file_id",
    "handle_users": "select concat('c', cast(o_custkey % 300 as varchar)) file_id, count(*) filter (o_orderkey % 4 <> 0) readers, count(*) filter (o_orderkey % 4 = 0) writers, sum(o_orderkey * 10)::bigint bytes from orders group by 1",
    "xattrs": "with k as (select concat('c', cast(c_custkey % 300 as varchar)) file_id, concat('user.k', c_custkey % 3) k, max(c_name) v from customer group by 1, 2) select file_id, count(*) attrs, max(case when k = 'user.k1' then v end) k1 from k group by file_id",
    "hostdirs": "with h as (select concat('c', cast(o_custkey % 30 as varchar)) file_id, o_orderkey * o_custkey % 32 hostdir from orders) select file_id, count(distinct hostdir) hostdirs, list_sort(list(distinct hostdir)) ids from h group by file_id",
    "metalinks": f"with {LINKS} select path, target from lk",
    "collect_contents": f"""with {LINKS}, ent as (select concat('/mnt/b', o_custkey % 13, '/dir/d', o_custkey, '/dropping.', (['index', 'data', 'meta'])[o_orderkey % 3 + 1], '.', o_orderkey) p from orders
  union all select concat('/store/v', o_custkey % 5, '/dir/l', o_custkey, '/dropping.data.', o_orderkey) from orders where o_custkey % 2 = 0),
rt as (select concat('/mnt/b', i * 5) root from range(2) r(i)),
fo as (select root, root f from rt union select root, replace(target, '//', '/') from rt join lk on starts_with(path, root || '/'))
select distinct root, p path from fo join ent on starts_with(p, f || '/') where split_part(p, '/', -1) like 'dropping.index%' or split_part(p, '/', -1) like 'dropping.data%'""",
    "writer_droppings": "select path from (select concat('/burst/hostdir.', o_orderkey % 32, case when o_orderkey % 5 = 0 then '/dropping.meta.' when o_orderkey % 2 = 0 then '/dropping.index.' else '/dropping.data.' end, o_orderkey, '.n.', o_custkey % 9) path from orders) where path like '%.7' and path not like '%dropping.meta%'",
    "list_prefixed": f"with {NAME_LOG} select distinct dir_id, name from nl where name like 'f1%' or name like 'f42%'",
    "grown_log": f"with {WRITE_LOG} select file_id, greatest(max(logical_offset + length), 1000600)::bigint eof, count(*) + case when max(logical_offset + length) < 1000600 then 1 else 0 end records from wl group by file_id",
    "small_lookup": f"""{SMALL_EXT}, sz as (select fid, coalesce(max(case when physical_offset = -1 then case when cut is null or cut >= off then off end when length > 0 and least(off + length, coalesce(cut, off + length)) > off then least(off + length, coalesce(cut, off + length)) end), 0)::bigint eof from lc group by fid),
pr as (select o_orderkey probe_id, o_orderkey % 210 fid, o_orderkey * 104729 % 70000 off from orders),
nx as (select pr.*, e.did, e.physical_offset + pr.off - e.off po, e.off + e.length - pr.off run, (select min(x.off) from ext x where x.fid = pr.fid and x.off > pr.off) after from pr left join ext e on pr.fid = e.fid and e.off <= pr.off and pr.off < e.off + e.length)
select probe_id, nx.fid, off, coalesce(did, -1) did, coalesce(po, -1) physical_offset, coalesce(run, after - off, greatest(eof - off, 0), 0)::bigint length from nx left join sz on nx.fid = sz.fid""",
    "replay_names": f"with {REPLAY} select dir_id, n as name, t mtime_us, coalesce(list_aggregate(list_transform(o, lambda x: x.fid || ':' || x.did), 'string_agg', ' '), '') opens from cur",
    "name_index": f"""with {REPLAY}, pairs as (select dir_id, n as name, unnest(o) p from cur)
select nl.dir_id, nl.did, rec_off fid, seq, seq % 7 * 100 off, 100 + seq % 50 length, ts_us, seq * 10 physical_offset, pairs.name from nl join pairs on nl.dir_id = pairs.dir_id and nl.did = p.did and rec_off = p.fid where op = 3""",
    "mounts": "select path, case when m = 0 and d = 1 then '/mnt/m0/d1' when m = 0 then '/mnt/m0' when m = 1 then '/mnt/m1' else '/mnt/m2/d2' end mount, case when m = 0 and d = 1 then 'b01' when m = 0 then 'b0' when m = 1 then 'b1' else 'b22' end backend from (select concat('/mnt/m', c_custkey % 4, '/d', c_custkey % 3, '/f', c_custkey) path, c_custkey % 4 m, c_custkey % 3 d from customer) where m < 2 or (m = 2 and d = 2)",
    "list_names": f"with {NAME_LOG} select distinct dir_id, name from nl",
    "replay_names_simple": f"with {NAME_LOG}, r as (select *, row_number() over (partition by dir_id, name order by ts_us desc, did desc, seq desc) rn from nl where op in (1, 2)) select dir_id, name, ts_us created_us from r where rn = 1 and op = 1",
    "merge_name_logs": f"with {NAME_LOG} select dir_id, did, seq, ts_us, op, name from nl order by ts_us, did, seq",
    "truncate_clip": f"with {SMALL} select * from cl where length > 0",
    "small_extents": f"{SMALL_EXT} select * from ext",
    "small_size": f"with {SMALL} select fid, coalesce(max(case when physical_offset = -1 then case when cut is null or cut >= off then off end when length > 0 and least(off + length, coalesce(cut, off + length)) > off then least(off + length, coalesce(cut, off + length)) end), 0)::bigint size from lc group by fid",
    "trace_projection": f'with {TRACE} select pid id, seq, logical_offset "offset", length, begin_us, end_us, logical_offset + length - 1 tail from tr',
    "trace_bounds": f"with {TRACE}, w as (select pid, min(begin_us) b, max(end_us) e from tr group by pid) select min(b) min_begin_us, max(e) max_end_us, sum(e)::bigint sum_end_us, count(*) writers from w",
    "trace_rejects": f"with {TRACE} select count(*) filter (not begin_us < end_us) rejected, count(*) records from tr",
    "writer_end": f"{ENDS} select * from we",
    "writer_spans": f"{ENDS}, m as (select pid, min(begin_us) b, max(end_us) e from tr group by pid) select pid, (b - (select min(begin_us) from tr)) / 1e6::double begin_s, (e - (select min(begin_us) from tr)) / 1e6::double end_s from m",
    "writer_stats": f"{ENDS}, x as (select (end_us - (select min(begin_us) from tr)) / 1e6::double x from we) select count(*) writers, round(avg(x), 6) mean_end_s, round(stddev_pop(x), 6) stddev_end_s from x",
    "stragglers": _stragglers("select count(*) filter (side = 'above') above, count(*) filter (side = 'below') below from sd"),
    "straggler_rows": _stragglers("select tr.pid, tr.seq, side from tr join sd on tr.pid = sd.pid where side is not null"),
    "bandwidth_bins": _bandwidth(),
    "bandwidth_fractional": _bandwidth(" * (((end_us - begin_us) * 500 % span) / span::double)"),
    "bin_times": f"{SPREAD} select bin, round((bin * span)::double / 500 / 1e6::double, 3) relative_s, round((z + (bin * span)::double / 500) / 1e6::double, 3) absolute_s from bins, sp",
    "ios_running": f"{SPREAD}, {COVER} select bins.bin, (select count(*) from b where bins.bin >= first_bin and bins.bin < first_bin + spanned - 1) running from bins",
    "ios_finished": f"{SPREAD}, f as (select bins.bin, count(b.seq) finished from bins left join b on least(first_bin + spanned - 1, 499) = bins.bin group by bins.bin) select bin, finished, coalesce(sum(finished) over (order by bin rows between unbounded preceding and 1 preceding), 0)::bigint finished_before from f",
    "size_histogram": f"with {TRACE} " + HIST.format("case when length < 2 then 0 else least(length(bin(length)) - 1, 50) end"),
    "size_histogram_serial": f"with {TRACE} " + HIST.format("case when length < 3 then 0 else least(length(bin(length // 3)), 50) end"),
    "downsample": f"""with {TRACE}, n as (select count(*) n, least(100 * count(distinct pid), 65536) lim from tr), st as (select min(1::bigint << k) step from n, range(62) r(k) where (n + (1::bigint << k) - 1) // (1::bigint << k) <= lim),
r as (select *, row_number() over (order by pid, begin_us, seq) - 1 rn from tr) select r.* exclude (rn) from r, st where rn % step = 0""",
    "op_stats": """with o as (select event_type op, cast(floor(value * 1000) as bigint) us, cast(floor(value * 4096) as bigint) // 1024 kb, case when event_type = 'error' then 1 else 0 end e from events),
s as (select op, count(*) calls, sum(e)::bigint errors, sum(us)::bigint us, sum(kb)::bigint kb from o group by rollup(op))
select op, calls, errors, round(us / 1e6::double, 6) as seconds, kb, case when us > 0 then round(calls / (us / 1e6::double), 6) end ops_per_s, case when us > 0 then round(kb / (us / 1e6::double) / 1024::double, 6) end mib_per_s from s""",
    "log_filter": f"with {MESSAGES} select event_id, facility, level from ms where {LET_THROUGH} and mask is not null",
    "log_filter_default": f"with {MESSAGES} select event_id, facility, level from (select event_id, facility, level, coalesce(mask, 2097152) mask from ms) where {LET_THROUGH}",
    "parse_messages": f"with {LINES} select value, date, host, split_part(host, '.', 1) short_host, tag, facility, level, message, error from ln",
    "format_messages": f"""with {LINES} select case error when 'invalid' then 'INVALID-MSG: ' || value when 'parse' then 'PARSE-ERR: ' || value else '' end
  || concat_ws(' ', coalesce(date, ''), coalesce(split_part(host, '.', 1), ''), coalesce(tag, ''), coalesce(facility, ''), coalesce(level, ''), coalesce(message, '')) line from ln""",
    "offset_triples": f'with {TRACE} select pid id, logical_offset beg, logical_offset + length - 1 "end" from tr',
    "time_triples": _stragglers("""select tr.pid::double id, begin_us / 1e6::double beg, tr.end_us / 1e6::double "end" from tr join sd on tr.pid = sd.pid where side is not null or n <= 16"""),
    "trace_report": f"""{REPORT} select * from rp""",
    "hash_bucket": f"""with {META}, h as (select host, list_reduce(list_prepend(0::hugeint, list_transform(string_split(host, ''), lambda x: ascii(x)::hugeint)), lambda a, c: (a * 65599 + c) % 18446744073709551616::hugeint) v from (select distinct host from mt))
select host, v::varchar hash, (v % 32)::int hostdir from h""",
    "human_size": f"with {META}, s as (select file_id, sum(total_bytes)::bigint bytes from mt group by file_id) select file_id, bytes, round(bytes::double / pow(1024, {UNIT}), 4) \"value\", (['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'])[{UNIT} + 1] unit, (length(bytes::varchar) - 1)::int exponent from s",
    "rank_groups": "select range rank, " + ", ".join(f"case when range < {1000 % g * (1000 // g + 1)} then range // {1000 // g + 1} else {1000 % g} + (range - {1000 % g * (1000 // g + 1)}) // {1000 // g} end of_{g}" for g in (7, 32, 300)) + " from range(1000)",
    "packed_times": f"with {NAME_LOG} select seq, (ts_us // 1000000) * 4294967296 + ts_us % 1000000 packed, ts_us // 1000000 as seconds, ts_us % 1000000 micros from nl",
    "clean_paths": "with p as (select c_custkey id, concat(case when c_custkey % 2 = 0 then '/' else '' end, 'a', c_custkey % 5, case when c_custkey % 4 = 0 then '/c' else concat('/b', c_custkey) end) clean from customer) select id, clean, replace(clean, '/', '_') flat from p",
}
