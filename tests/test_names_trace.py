"""Name logs, small files, traces, metadata and functions."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators import names, stat, trace
from tidelog.plans.queries import QUERIES

NAME_LOG = "dir_id string, did long, rec_off long, seq long, ts_us long, op int, name string, name_to string"
SMALL = "did long, fid long, seq long, off long, length long, ts_us long, physical_offset long"


def test_creates_over_ten_logs(spark):
    made = [("d", i % 10, 32 * i, i, i, 1, f"FILE-{i}", None) for i in range(1000)]
    gone = [("d", (i + 1) % 10, 0, 1000 + i, 1000 + i, 2, f"FILE-{i}", None) for i in range(900)]
    frame = spark.createDataFrame(made + gone, NAME_LOG)
    want = {f"FILE-{i}" for i in range(900, 1000)}
    assert {r["name"] for r in names.replay(frame).collect()} == want == {r["name"] for r in names.replay_simple(frame).collect()}


def test_renames_across_logs(spark):
    made = [("d", i % 10, 32 * i, i, i, 1, f"FILE-{i}", None) for i in range(300)]
    moved = [("d", (i + 1) % 10, 0, 300 + i, 300 + i, 4, f"FILE-{i}", f"RENAMED-{i}") for i in range(300)]
    got = names.replay(spark.createDataFrame(moved + made, NAME_LOG)).collect()
    assert {r["name"] for r in got} == {f"RENAMED-{i}" for i in range(300)}


def test_groups_of_renames(spark):
    chain = [("d", 0, 0, k, k, 4, f"c{k:02}", f"c{k + 1:02}") for k in range(9)]
    pairs = [("d", 0, 0, 100 + k, k, 4, f"tmp{k}", f"final{k}") for k in range(20)] + [("e", 0, 0, 200, 0, 4, "c00", "c01")]
    got = {(r["dir_id"], r["name"]): (r["root"], r["chained"]) for r in names.rename_groups(spark.createDataFrame(chain + pairs, NAME_LOG)).collect()}
    assert {n for (d, n), (_, c) in got.items() if c} == {f"c{k:02}" for k in range(10)}
    assert all(got["d", f"tmp{k}"] == got["d", f"final{k}"] == (f"final{k}", False) for k in range(20))
    assert got["e", "c01"] == ("c00", False) and len(got) == 10 + 40 + 2


@pytest.mark.parametrize(("known", "renames"), [(12, 0.2), (150, 0.25), (150, 0.1)])
def test_replay_is_a_fold(spark, known, renames):
    rng = random.Random(3)
    kind = lambda: 4 if rng.random() < renames else rng.choice((1, 1, 2, 3, 5))
    log = [(rng.choice("xy"), rng.randrange(3), 10 * k, k, rng.randrange(150), kind(), f"n{rng.randrange(known)}", f"n{rng.randrange(known)}") for k in range(40 * 12 if known > 12 else 200)]
    rows = {}
    for d, did, rec, _, ts, op, a, b in sorted(log, key=lambda r: (r[4], r[1], r[3])):
        key = (d, a)
        if op == 1:
            rows.setdefault(key, [ts, []])
        elif key in rows:
            if op in (3, 5):
                rows[key][0] = ts
            if op == 3:
                rows[key][1].append((rec, did))
            if op == 2:
                del rows[key]
            if op == 4:
                rows[d, b] = rows.pop(key)
    got = {(r["dir_id"], r["name"]): [r["mtime_us"], [tuple(o) for o in r["opens"]]] for r in names.replay(spark.createDataFrame(log, NAME_LOG), records=50).collect()}
    assert got == rows


@pytest.mark.parametrize("seed", range(4))
def test_small_files_are_a_fold(spark, seed):
    rng, log = random.Random(seed), []
    for k in range(40):
        cut = rng.random() < 0.25
        log.append((rng.randrange(2), rng.randrange(2), k, rng.randrange(90), 0 if cut else rng.randrange(1, 40), k, -1 if cut else 1000 * k))
    held, size = {}, {}
    for _, fid, seq, off, length, _, phys in sorted(log, key=lambda r: r[5]):
        own = held.setdefault(fid, {})
        if phys < 0:
            held[fid] = {b: v for b, v in own.items() if b < off}
            size[fid] = off
        else:
            own |= {off + b: (seq, phys + b) for b in range(length)}
            size[fid] = max(size.get(fid, 0), off + length)
    frame = spark.createDataFrame(log, SMALL)
    got = {}
    for r in names.small_extents(frame, 16).collect():
        got.setdefault(r["fid"], {}).update({r["off"] + b: (r["seq"], r["physical_offset"] + b) for b in range(r["length"])})
    assert got == {f: own for f, own in held.items() if own}
    assert {r["fid"]: r["size"] for r in names.small_size(frame).collect()} == size


# Where the scenario's truncates cut.
CUTS = (9373, 3524, 5876, 2010, 91)


@pytest.mark.parametrize("apart", [1, 1 << 34])
def test_truncates_of_the_scenario(spark, apart):
    rows = [(i % 10, 1, i, 10 * i, 10, i * apart, 10 * (i // 10)) for i in range(1000)]
    cuts = [(0, 1, 1000 + k, off, 0, (1000 + k) * apart, -1) for k, off in enumerate(CUTS)]
    for k in range(1, 6):
        assert names.small_size(spark.createDataFrame(rows + cuts[:k], SMALL)).first()["size"] == cuts[k - 1][3]


def test_size_buckets(spark):
    sizes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 1024, 47001, 1048576, 1 << 50, (1 << 62)]
    got = spark.createDataFrame([(x,) for x in sizes], "x long").select(scalar.log2_bucket(F.col("x")), scalar.log2_bucket_serial(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 10, 15, 20, 50, 50]
    assert [r[1] for r in got][:14] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 9, 14, 19]


def test_outliers_of_few_writers_use_the_mean(spark):
    for n in (16, 17):
        frame = spark.createDataFrame([(p, p, 0, 1, 0, 100 + p) for p in range(n)], "pid long, seq long, logical_offset long, length long, begin_us long, end_us long")
        got = trace.straggler_counts(frame).first()
        assert (got["above"], got["below"]) == ((8, 8) if n == 16 else (4, 4))


def test_bins_clip_and_reject(spark):
    frame = spark.createDataFrame([(1, 1, 0, 10, 0, 1000), (1, 2, 0, 10, 999, 1000), (1, 3, 0, 10, 5, 5), (1, 4, 0, 10, 9, 2)], "pid long, seq long, logical_offset long, length long, begin_us long, end_us long")
    assert trace.rejects(frame).first()["rejected"] == 2
    assert sum(r["finished"] for r in trace.ios_finished(frame, 10).collect()) == 2
    assert [r["running"] for r in trace.ios_running(frame, 10).collect()] == [1] * 9 + [0]


def test_names_with_dots(spark):
    got = stat.parse_meta_names(spark.createDataFrame([("12.34.5.6.a.b.c",), ("bad",)], "name string")).collect()
    assert [tuple(r)[1:] for r in got] == [(12, 34, 5000006, "a.b.c")]
    assert stat.parse_open_names(spark.createDataFrame([("open.h.x.77",)], "name string")).first()["pid"] == 77


def test_hash_and_paths(spark):
    def slow(text):
        h = 0
        for c in text:
            h = (ord(c) + h * 65599) % (1 << 64)
        return h

    texts = ["", "a", "host12", "x" * 60]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.string_hash(F.col("t")).cast("string").alias("h")).collect()
    assert {r["t"]: int(r["h"]) for r in got} == {t: slow(t) for t in texts}
    paths = {"/a//b/./c": "/a/b/c", "/a/../..": "/", "../x": "../x", "a/..": ".", "/": "/"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalar.clean_path(F.col("p")).alias("c")).collect()
    assert {r["p"]: r["c"] for r in got} == paths


def test_lookups_of_the_scenario(spark):
    rows = [(i % 10, 1, i, 10 * i, 10, i, 10 * (i // 10)) for i in range(1000)]
    probes = spark.createDataFrame([(i, 1, 10 * i) for i in range(1000)] + [(1000, 1, 10_000), (1001, 1, 10_003), (1002, 2, 0), (1003, 1, 37)], "probe_id long, fid long, off long")
    got = {r["probe_id"]: (r["did"], r["physical_offset"], r["length"]) for r in names.small_lookup(spark.createDataFrame(rows, SMALL), probes).collect()}
    assert all(got[i] == (i % 10, 10 * (i // 10), 10) for i in range(1000))
    assert got[1000] == got[1001] == got[1002] == (-1, -1, 0) and got[1003] == (3, 7, 3)
    cut = [*rows, (0, 1, 1000, 91, 0, 2000, -1), (3, 1, 1001, 200, 5, 2001, 777), (0, 1, 1002, 300, 0, 2002, -1)]
    got = {r["probe_id"]: (r["did"], r["physical_offset"], r["length"]) for r in names.small_lookup(spark.createDataFrame(cut, SMALL), probes).collect()}
    assert got[9] == (9, 0, 1) and got[10] == (-1, -1, 100) and got[20] == (3, 777, 5) and got[21] == (-1, -1, 90) and got[30] == (-1, -1, 0)


def test_records_of_opened_files(spark):
    log = [("d", 1, 0, 0, 1, 1, "a", None), ("d", 1, 32, 1, 2, 3, "a", None), ("d", 2, 64, 2, 3, 4, "a", "b"), ("d", 2, 96, 3, 4, 3, "b", None), ("d", 2, 128, 4, 5, 1, "c", None), ("d", 2, 160, 5, 6, 3, "c", None), ("d", 2, 192, 6, 7, 2, "c", None)]
    index = [("d", 1, 32, 5), ("d", 2, 96, 6), ("d", 2, 160, 7), ("e", 1, 32, 8)]
    found = names.index_of_names(names.replay(spark.createDataFrame(log, NAME_LOG)), spark.createDataFrame(index, "dir_id string, did long, fid long, off long"))
    assert sorted((r["name"], r["did"], r["off"]) for r in found.collect()) == [("b", 1, 5), ("b", 2, 6)]


def test_metalinks_strip_and_prefix(spark):
    links = spark.createDataFrame([("/canonical/dir/x", "10/shadow"), ("/c/y", "2/gone"), ("/c/z", "12"), ("/c/\u00e9/w", "5/shadow"), ("/c/v", "/shadow")], "path string, text string")
    known = spark.createDataFrame([("/shadow",), ("/other",)], "backend string")
    got = {r["path"]: r["target"] for r in stat.resolve_metalinks(links, known).collect()}
    assert got == {"/canonical/dir/x": "/shadow//dir/x", "/c/\u00e9/w": "/shadow//w", "/c/v": "/shadow//c/v"}  # lengths are in bytes


def test_contents_behind_metalinks(spark):
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    entries = frame(["/a/f/dropping.index.1", "/a/f/other", "/b/f/s/dropping.data.2", "/b/g/dropping.data.3", "/c/f/s/t/dropping.data.4"])
    links = spark.createDataFrame([("/a/f/s", "2/b"), ("/b/f/s/t", "2/c"), ("/a/f/gone", "2/b")], "path string, text string")
    known = spark.createDataFrame([("/b",), ("/c",)], "backend string")
    roots = spark.createDataFrame([("/a/f",)], "root string")
    assert sorted(r["path"] for r in stat.collect_contents(entries, links, known, roots).collect()) == ["/a/f/dropping.index.1", "/a/f/other", "/b/f/s/dropping.data.2", "/c/f/s/t/dropping.data.4"]
    assert sorted(r["path"] for r in stat.collect_contents(entries, links, known, roots, ("dropping.data.",), 1).collect()) == ["/b/f/s/dropping.data.2"]


def test_filters_do_not_compare_their_last_byte(spark):
    names_ = spark.createDataFrame([("d", n) for n in ("dropping.index.1", "dropping.indexes", "dropping.inde", "x")], "dir_id string, name string")
    assert {r["name"] for r in stat.list_names(names_, ("dropping.index.",)).collect()} == {"dropping.index.1", "dropping.indexes"}


def test_messages(spark):
    lines = ["12:01  h.site.org tag fac WARN the  text ", "12:01 h tag fac WARN", "x h.y t f l m n", "12:01 h tag fac WARN "]
    parsed = trace.messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["line"] for r in trace.formatted(parsed, "dHm").collect()] == ["12:01 h the  text ", f"PARSE-ERR: {lines[1]}  ", f"INVALID-MSG: {lines[2]}x h m n", f"PARSE-ERR: {lines[3]}  "]


def test_debug_streams_pass_by_their_bits(spark):
    rows = spark.createDataFrame([(k, "a", 1 << k) for k in range(16, 23)] + [(99, "b", 1 << 22)], "id int, facility string, level int")
    pass_ = lambda mask, default=None: {r["id"] for r in trace.log_filter(rows, spark.createDataFrame([("a", mask)], "facility string, mask long"), default).collect()}
    assert pass_(0x50000) == {16, 18, 20, 21, 22} and pass_(0x200000) == {21, 22} and pass_(0x400000, 0x100000) == {22, 99}


def test_bandwidth_is_the_sum_over_covered_bins(spark):
    rng = random.Random(5)
    rows = [(p, k, 0, rng.randrange(1, 10**6), b := rng.randrange(10**9), b + rng.randrange(1, 10**8)) for k, p in enumerate(range(200))]
    frame = spark.createDataFrame(rows, "pid long, seq long, logical_offset long, length long, begin_us long, end_us long")
    z, span = min(r[4] for r in rows), max(r[5] for r in rows) - min(r[4] for r in rows)
    want = [0.0] * 50
    for *_, n, b, e in rows:
        first, spanned = (b - z) * 50 // span, -(-(e - b) * 50 // span)
        for k in range(min(first, 49), min(first + spanned - 1, 49) + 1):
            want[k] += n / ((e - b) / 1e6) / 1048576
    assert [r["mib_s"] for r in trace.bandwidth_bins(frame, 50).orderBy("bin").collect()] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("writers", [0, 36, 37])
def test_sums_of_last_ends_may_pass_a_long(spark, tmp_path, writers):
    # of the year 9999: 36 writers' ends fit a long, 37 do not
    made = spark.range(2 * writers).selectExpr("id as event_id", "timestamp_ntz'9999-01-01 00:00:00' as ts", "id div 2 as user_id", "1D as value")
    made.write.parquet(f"{tmp_path}/events.parquet")
    begin = 253370764800000000
    ends = [begin + (2 + 2 * p) * 60000000 for p in range(writers)]
    got = QUERIES["trace_bounds"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(begin, ends[-1], sum(ends), writers) if writers else (None, None, None, 0)]
    assert dict(got.dtypes) == {"min_begin_us": "bigint", "max_end_us": "bigint", "sum_end_us": "decimal(38,0)" if sum(ends) >= 1 << 63 else "bigint", "writers": "bigint"}
    assert (sum(ends) >= 1 << 63) == (writers == 37)


def test_a_report_of_many_writers_has_their_mean(spark):
    base = 1 << 61  # 4 such ends pass a long
    rows = [(p, p, 0, 1 << p, base + p * 1000000, base + (p + 5) * 1000000) for p in range(20)]
    frame = spark.createDataFrame(rows, "pid long, seq long, logical_offset long, length long, begin_us long, end_us long")
    got = {(r["section"], r["idx"]): r["value"] for r in trace.report(frame, 10).collect()}
    ends = [r[5] for r in rows]
    assert [got["head", k] for k in range(6)] == [10.0, base / 1e6, float(sum(ends)) / 20 / 1e6, 24e6 / 10 / 1e6, 4.0, 4.0]
    assert len(got) == 6 + 3 * 10 + 51 and sum(v for (s, _), v in got.items() if s == "finished") == 20 == sum(v for (s, _), v in got.items() if s == "sizes")
