"""Bytes written to a store and read back."""

import random

import pytest

from tidelog.shipping import ship
from tidelog.sources import stores

REQUESTS = "file_id string, pid long, seq long, logical_offset long, data binary"


@pytest.mark.parametrize("cell", [64, 1 << 20])
def test_reads_are_what_was_written_last(spark, tmp_path, monkeypatch, cell):
    ship(spark)
    monkeypatch.setattr(stores, "CELL", cell)
    rng, held, path = random.Random(5), {}, str(tmp_path / "store")
    for batch in range(3):
        made = [(rng.choice("fg"), rng.randrange(3), k, rng.randrange(400), rng.randbytes(rng.choice((0, 1, 30, 90)))) for k in range(25)]
        stores.write(spark.createDataFrame(made, REQUESTS), path)
        for f, pid, seq, at, data in sorted(made, key=lambda r: (r[1], r[2])):  # one call's writes have one time
            own = held.setdefault(f, bytearray())
            own.extend(b"\0" * (at + len(data) - len(own)))
            own[at : at + len(data)] = data
    probes = [(k, rng.choice("fgh"), rng.randrange(500), rng.randrange(0, 200)) for k in range(60)] + [(60, "f", 0, 1000), (61, "g", 0, 1000)]
    got = {}
    for r in stores.read(spark, path, spark.createDataFrame(probes, "probe_id long, file_id string, offset long, length long")).collect():
        assert r["hole"] == (r["data"] is None) and (r["hole"] or len(r["data"]) == r["length"])
        got.setdefault(r["probe_id"], []).append((r["logical_offset"], bytes(r["data"] or b"\0" * r["length"])))
    for k, f, at, n in probes:
        pieces = sorted(got.get(k, []))
        assert b"".join(p for _, p in pieces) == bytes(held.get(f, b"")[at : at + n])
        assert not pieces or pieces[0][0] == at


def test_failed_calls_leave_no_wrong_bytes(spark, tmp_path):
    ship(spark)
    path = tmp_path / "store"
    (path / "data" / "batch=0" / "_temporary").mkdir(parents=True)  # of a call that failed before any row was there
    stores.write(spark.createDataFrame([("f", 1, 0, 0, b"abc"), ("f", 1, 1, 3, None)], REQUESTS), str(path))
    (path / "index").rename(path / "kept")
    stores.write(spark.createDataFrame([("f", 1, 0, 0, b"lost")], REQUESTS), str(path))
    (path / "index").rename(path / "gone")
    (path / "kept").rename(path / "index")
    stores.write(spark.createDataFrame([("f", 1, 0, 1, b"XY")], REQUESTS), str(path))
    records = sorted(tuple(r) for r in stores.index(spark, str(path)).select("seq", "logical_offset", "length", "physical_offset").collect())
    assert records == [(0, 0, 3, 0), (1, 3, 0, 3), (3, 1, 2, 7)]
    pieces = stores.read(spark, str(path), spark.createDataFrame([(1, "f", 0, 9)], "probe_id long, file_id string, offset long, length long")).orderBy("logical_offset").collect()
    assert b"".join(bytes(r["data"]) for r in pieces) == b"aXY"
