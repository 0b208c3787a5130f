"""Extent operators against a byte map, and hand-checked scenarios."""

import random

import pandas as pd
import pytest

from tidelog.operators import extents, sweep

COLUMNS = "file_id string, pid long, seq long, logical_offset long, physical_offset long, length long, begin_us long, end_us long"


def owners(log):
    """file -> byte -> (pid, seq, physical byte), newest wins."""
    out = {}
    for f, pid, seq, off, phys, size, begin, end in sorted(log, key=lambda r: (r[7], r[6], r[1], r[2])):
        for k in range(size):
            out.setdefault(f, {})[off + k] = (pid, seq, phys + k)
    return out


def spread(rows):
    out = {}
    for r in rows:
        for k in range(r["length"]):
            assert r["logical_offset"] + k not in out.setdefault(r["file_id"], {})
            out[r["file_id"]][r["logical_offset"] + k] = (r["pid"], r["seq"], r["physical_offset"] + k)
    return out


def random_log(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(4), k, rng.randrange(300), 1000 * k, rng.choice([0, 1, 5, 30, 120]), rng.randrange(9), rng.randrange(6)) for k in range(n)]


@pytest.mark.parametrize("tile", [7, 64, 1 << 16])
def test_resolution_is_newest_wins(spark, tile):
    for seed in range(3):
        log = random_log(seed)
        rows = extents.resolve(spark.createDataFrame(log, COLUMNS), tile).collect()
        assert spread(rows) == owners(log)


def test_edges(spark):
    for log in ([], [("a", 1, 0, 5, 0, 0, 1, 1)], [("a", 1, 0, 1 << 33, 0, 4, 1, 1)], [("a", 1, 0, 0, 0, 4, 1, 1), ("a", 1, 1, 0, 4, 4, 1, 1)], [("a", 1, 0, 0, 0, 9, 1, 5), ("a", 2, 1, 2, 0, 3, 1, 5)]):
        assert spread(extents.resolve(spark.createDataFrame(log, COLUMNS)).collect()) == owners(log)


def test_merge_is_resolution_of_both(spark):
    log = random_log(9)
    a, b = spark.createDataFrame(log[::2], COLUMNS), spark.createDataFrame(log[1::2], COLUMNS)
    assert spread(extents.merge(a, b).collect()) == owners(log)


def test_holes_of_the_scenario(spark):
    log = [("f", 1, k, lo, 0, hi - lo, 1, 1) for k, (lo, hi) in enumerate([(3, 5), (8, 12), (18, 18), (20, 25)])]
    frame = spark.createDataFrame(log, COLUMNS)
    got = sorted((r["hole_offset"], r["hole_length"]) for r in extents.holes(extents.resolve(frame)).collect())
    assert got == [(0, 3), (5, 3), (12, 8)]
    assert extents.file_stats(frame).first()["eof"] == 25


@pytest.mark.parametrize("scale", [1, 1000])
def test_range_and_stab_queries(spark, scale):
    tile, log = 16 if scale == 1 else 1 << 16, [(*r[:3], r[3] * scale, r[4] * scale, r[5] * scale, *r[6:]) for r in random_log(4)]
    frame = spark.createDataFrame(log, COLUMNS)
    own, eof = owners(log), {f: max(r[3] + r[5] for r in log if r[0] == f) for f in "ab"}
    asked = [(k, "ab"[k % 2], 17 * k % 430 * scale, (1 + 13 * k % 90) * scale) for k in range(40)]
    probes = spark.createDataFrame(asked, "probe_id long, file_id string, offset long, length long")
    ends = extents.file_stats(frame)
    rows = extents.range_query(extents.resolve(frame, tile), probes, ends).collect()
    for k, f, off, size in asked:
        mine = sorted((r for r in rows if r["probe_id"] == k), key=lambda r: r["logical_offset"])
        assert sum(r["length"] for r in mine) == max(0, min(off + size, eof[f]) - off)
        assert [r["last_record"] for r in mine] == [False] * (len(mine) - 1) + [True] * bool(mine)
        for r in mine:
            for b in range(r["length"]):
                assert own[f].get(r["logical_offset"] + b) == (None if r["hole"] else own[f][r["logical_offset"] + b])
                assert r["hole"] or own[f][r["logical_offset"] + b][2] == r["chunk_offset"] + b
    for r in extents.stab_lookup(extents.resolve(frame), probes, tile, ends).collect():
        want = own[r["file_id"]].get(r["offset"])
        assert r["state"] == ("data" if want else "hole" if r["offset"] < eof[r["file_id"]] else "eof")
        assert want is None or want[2] == r["chunk_offset"]


def test_adjacent_writes_coalesce(spark):
    frame = spark.createDataFrame([("f", 1, 0, 0, 0, 4, 1, 1), ("f", 1, 1, 4, 4, 4, 2, 2), ("f", 1, 2, 8, 20, 4, 3, 3)], COLUMNS)
    got = {(r["logical_offset"], r["length"], r["pieces"]) for r in extents.coalesce(extents.resolve(frame)).collect()}
    assert got == {(0, 8, 2), (8, 4, 1)}
    assert [(r["length"], r["records"]) for r in extents.contiguous_writes(frame).collect()] == [(12, 3)]


def test_truncate_and_grow(spark):
    log = random_log(6)
    frame = spark.createDataFrame(log, COLUMNS)
    got = spread(extents.truncate(extents.resolve(frame), 100).collect())
    assert got == {f: {k: v for k, v in own.items() if k < 100} for f, own in owners(log).items()}
    assert extents.truncate(extents.resolve(frame), 0).collect() == []
    assert {r["grown"] for r in extents.resized_eof(extents.file_stats(frame), 10_000).collect()} == {True}


def test_ties_go_to_the_later_begin_then_the_higher_writer(spark):
    frame = spark.createDataFrame([("f", 1, 0, 0, 0, 4, 5, 9), ("f", 9, 1, 0, 0, 4, 4, 9), ("g", 1, 2, 0, 0, 4, 5, 9), ("g", 2, 3, 0, 0, 4, 5, 9)], COLUMNS)
    assert {r["file_id"]: r["pid"] for r in extents.resolve(frame).collect()} == {"f": 1, "g": 2}


def test_one_writer_and_overlap_counts(spark):
    log = random_log(8)
    frame = spark.createDataFrame(log, COLUMNS)
    assert spread(extents.only_writer(frame, 2).collect()) == owners([r for r in log if r[1] == 2])
    for r in extents.overlaps(frame).collect():
        a = next(x for x in log if x[2] == r["seq"])
        assert r["overlapping"] == sum(b[0] == a[0] and b[2] != a[2] and b[5] > 0 and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] for b in log)


def test_a_file_of_empty_records_is_a_hole(spark):
    frame = spark.createDataFrame([("f", 1, 0, 30, 0, 0, 1, 1)], COLUMNS)
    probes = spark.createDataFrame([(1, "f", 10, 50)], "probe_id long, file_id string, offset long, length long")
    got = extents.range_query(extents.resolve(frame), probes, stats=extents.file_stats(frame)).collect()
    assert [(r["hole"], r["logical_offset"], r["length"], r["last_record"]) for r in got] == [(True, 10, 20, True)]


def test_many_records_over_one_tile(spark):
    rng = random.Random(11)
    log = [("h", rng.randrange(9), k, rng.randrange(3000), 64 * k, rng.randrange(1, 400), rng.randrange(10**6), rng.randrange(10**6)) for k in range(50_000)]
    got = spread(extents.resolve(spark.createDataFrame(log, COLUMNS).repartition(8)).collect())
    assert got == owners(log)


def test_a_tile_is_folded_over_batches():
    rng = random.Random(12)
    rows = sorted((rng.randrange(3), rng.randrange(50), 0, k, k % 7) for k in range(400))
    frame = pd.DataFrame([(f, 0, lo, lo + 5, end, seq) for f, lo, _, seq, end in rows], columns=["f", "tile", "lo", "hi", "end", "seq"])
    whole = sweep.reduced(frame, ["f", "tile"], ["end", "seq"])
    for step, held in ((1, 4), (7, 20), (150, 1 << 17)):
        kept, sweep.HELD = sweep.HELD, held
        try:
            parts = list(sweep.folded(["f", "tile"], ["end", "seq"])(frame.iloc[k : k + step] for k in range(0, len(frame), step)))
        finally:
            sweep.HELD = kept
        key = lambda d: sorted((r.f, b, r.end, r.seq) for r in d.itertuples() for b in range(r.lo, r.hi))
        assert key(pd.concat(parts)) == key(whole)


def test_growing_adds_an_empty_record(spark):
    log = [("f", 1, 0, 0, 0, 9, 1, 1), ("g", 1, 1, 0, 9, 90, 2, 2)]
    grown = extents.grown(spark.createDataFrame(log, COLUMNS), 50)
    assert {r["file_id"]: r["eof"] for r in extents.file_stats(grown).collect()} == {"f": 50, "g": 90}
    assert spread(extents.resolve(grown).collect()) == owners(log)
    probes = spark.createDataFrame([(1, "f", 0, 100)], "probe_id long, file_id string, offset long, length long")
    got = extents.range_query(extents.resolve(grown), probes, extents.file_stats(grown)).orderBy("logical_offset").collect()
    assert [(r["hole"], r["logical_offset"], r["length"]) for r in got] == [(False, 0, 9), (True, 9, 41)]


def test_chains_go_on_over_buckets(spark):
    log = [("f", 1, 65_530 + k, 10 * k, 10 * k, 10, k, k) for k in range(12)]
    assert [(r["length"], r["records"]) for r in extents.contiguous_writes(spark.createDataFrame(log, COLUMNS)).collect()] == [(120, 12)]
    big = [("f", 1, k, (k << 25) - (1 << 20), k << 25, 1 << 25, k, k) for k in range(1, 9)]
    assert [(r["length"], r["pieces"]) for r in extents.coalesce(extents.resolve(spark.createDataFrame(big, COLUMNS))).collect()] == [(8 << 25, 8)]
