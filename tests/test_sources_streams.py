"""Log files and streams."""

import pytest

from tidelog.operators import trace as traces
from tidelog.operators.extents import resolve
from tidelog.shipping import ship
from tidelog.sources import logs
from tidelog.streaming import streams

LOG = "file_id string, pid long, seq long, logical_offset long, physical_offset long, length long, begin_us long, end_us long"
ROWS = [("f", 1, 0, 0, 0, 10, 1, 1), ("e", 1, 9, 500, 0, 0, 1, 1), ("f", 2, 1, 5, 0, 10, 2, 2), ("g", 1, 2, 0, 10, 4, 3, 3), ("f", 1, 3, 2, 14, 4, 0, 0)]


def test_binary_logs(spark, tmp_path):
    ship(spark)
    folder = tmp_path / "file1" / "hostdir.3"
    folder.mkdir(parents=True)
    (folder / "dropping.index.12.34.node.7.99").write_bytes(logs.encode_write_log([(5, 0, 10, 1.5, 2.25, 99), (20, 10, 0, 3.0, 3.0, 99)]) + b"partial")
    (folder / "dropping.data.12.34.node.7.99").write_bytes(b"x")
    got = [r.asDict() for r in logs.read_write_logs(spark, str(tmp_path)).orderBy("seq").collect()]
    assert [(r["file_id"], r["host"], r["pid"], r["seq"], r["logical_offset"], r["length"], r["begin_us"], r["end_us"]) for r in got] == [("file1", "node.7", 99, 0, 5, 10, 1_500_000, 2_250_000), ("file1", "node.7", 99, 1, 20, 0, 3_000_000, 3_000_000)]


def test_name_logs(spark, tmp_path):
    ship(spark)
    first = logs.encode_name(1, 5_000_007, "alpha")
    (tmp_path / "dropping.name.4").write_bytes(first + logs.encode_name(4, 6_000_000, "alpha", "beta"))
    got = [tuple(r[c] for c in ("did", "rec_off", "op", "ts_us", "name", "name_to")) for r in logs.read_name_logs(spark, str(tmp_path)).orderBy("rec_off").collect()]
    assert got == [(4, 0, 1, 5_000_007, "alpha", None), (4, len(first), 4, 6_000_000, "alpha", "beta")]


def test_names_of_half_a_rename(spark, tmp_path):
    ship(spark)
    (tmp_path / "dropping.name.1").write_bytes(logs.encode_name(4, 1, "only"))
    assert [(r["name"], r["name_to"]) for r in logs.read_name_logs(spark, str(tmp_path)).collect()] == [("only", None)]


def test_small_logs(spark, tmp_path):
    ship(spark)
    rows = [(7, 0, 10, 1_000_005, 0), (8, 5, 4, 2_000_000, 10), (7, 6, 0, 3_000_000, -1)]
    (tmp_path / "dropping.small.12").write_bytes(logs.encode_small_log(rows) + b"half")
    got = [tuple(r[c] for c in ("did", "seq", "fid", "off", "length", "ts_us", "physical_offset")) for r in logs.read_small_logs(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(12, k, *r) for k, r in enumerate(rows)]
    assert [(r["seq"], r["fid"]) for r in logs.read_small_logs(spark, str(tmp_path), fids=(7,)).orderBy("seq").collect()] == [(0, 7), (2, 7)]


def test_logs_in_splits(spark, tmp_path):
    ship(spark)
    folder = tmp_path / "file1" / "hostdir.3"
    folder.mkdir(parents=True)
    log = lambda pid, n: logs.encode_write_log([(10 * k, k, 1 + k % 7, k / 4, k / 4 + 1, pid) for k in range(n)])
    whole = {"dropping.index.1.2.node.1": log(1, 1000), "dropping.index.1.2.node.2": log(2, 999) + b"partial", "dropping.index.1.2.n[1],x.3": log(3, 800), "dropping.index.1.2.node.4": log(4, 5) + b"half", "dropping.index.1.2.node.5": b""}
    for name, content in whole.items():
        (folder / name).write_bytes(content)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    plain, cut = logs.read_write_logs(spark, str(tmp_path)), logs.read_write_logs(spark, str(tmp_path), large=4800, split=1000)
    assert key(cut) == key(plain) and cut.count() == 1000 + 999 + 800 + 5
    assert cut.rdd.getNumPartitions() >= 48  # 48,000 bytes in splits of 20 records
    seqs = cut.where("pid = 1").select("seq", "logical_offset").orderBy("seq").collect()
    assert [(r["seq"], r["logical_offset"]) for r in seqs] == [(k, 10 * k) for k in range(1000)]


def test_serial_trace(spark, tmp_path):
    head = "# Index of file\n# 0 /store/hostdir.1/dropping.data.12.34.node.4711\n# 1 /store/hostdir.2/dropping.data.12.35.node.99\nID Logical_offset Length Begin_timestamp End_timestamp  Logical_tail ID.Chunk_offset \n"
    (tmp_path / "a.txt").write_text(head + "0 w 0 10 0.5 1.5 9 [0.0]\n1 w 10 5 1.0 2.0 14 [1.0]\n5 w 20 1 1.0 2.0 20\n")
    got = [(r["id"], r["pid"], r["offset"], r["end"]) for r in logs.read_serial_trace(spark, str(tmp_path / "a.txt")).orderBy("id").collect()]
    assert got == [(0, 4711, 0, 1.5), (1, 99, 10, 2.0), (5, None, 20, 2.0)]


TRACE = "pid long, seq long, logical_offset long, length long, begin_us long, end_us long"


def test_report_and_its_reader(spark, tmp_path):
    trace = spark.createDataFrame([(k % 20, k, 100 * k, 1 + k, 1000 * k, 1000 * k + 50 * (k + 1)) for k in range(60)], TRACE)
    logs.write_report(trace, str(tmp_path / "report"), 10)
    key = lambda rows: sorted((r["section"], r["idx"], round(r["value"], 4)) for r in rows)
    again = logs.read_report(spark, str(tmp_path / "report"))
    assert key(again.collect()) == key(traces.report(trace, 10).collect()) and again.count() == 6 + 30 + 51
    assert [round(r["start_s"], 6) for r in logs.bin_starts(again).orderBy("idx").collect()][:2] == [0.0, 0.0062]


def test_triples(spark, tmp_path):
    ship(spark)
    (tmp_path / "q").write_bytes(logs.encode_triples([(1, 0, 9), (0, 0, 0), (2, 10, 14)]) + b"half")
    (tmp_path / "d").write_bytes(logs.encode_triples([(1.0, 0.5, 9.25)], "d"))
    assert [tuple(r) for r in logs.read_triples(spark, str(tmp_path / "q")).orderBy("id").collect()] == [(1, 0, 9), (2, 10, 14)]
    assert [tuple(r) for r in logs.read_triples(spark, str(tmp_path / "d"), "d").collect()] == [(1.0, 0.5, 9.25)]


def test_transfer_of_one_writer(spark, tmp_path):
    folder = tmp_path / "burst" / "hostdir.3"
    folder.mkdir(parents=True)
    for name in ("dropping.index.1.2.n.7", "dropping.data.1.2.n.7", "dropping.data.1.2.n.17", "meta.7"):
        (folder / name).write_bytes(name.encode())
    logs.transfer(spark, str(tmp_path / "burst"), str(tmp_path / "store"), 7)
    out = {p.name: p.read_bytes() for p in (tmp_path / "store" / "hostdir.3").glob("dropping*")}
    assert out == {n: n.encode() for n in ("dropping.index.1.2.n.7", "dropping.data.1.2.n.7")}


def test_appending_and_extending(spark, tmp_path):
    rows = [("f", 1, 0, 0, 0, 10, 1, 1), ("f", 1, 1, 10, 10, 5, 2, 2), ("f", 1, 2, 40, 15, 5, 3, 3)]
    frame = spark.createDataFrame(rows, LOG)
    for path, extend, want in (("plain", False, 3), ("joined", True, 2)):
        logs.append_log(frame, str(tmp_path / path), extend)
        got = spark.read.parquet(str(tmp_path / path))
        assert got.columns == frame.columns and got.count() == want
    assert [(r["logical_offset"], r["length"], r["seq"]) for r in got.orderBy("seq").collect()] == [(0, 15, 0), (40, 5, 2)]


def test_newest_record_at_each_offset(spark):
    rows = [("f", 1, 0, 0, 0, 10, 1, 5), ("f", 2, 1, 0, 0, 4, 2, 9), ("f", 2, 2, 8, 0, 4, 2, 1)]
    assert {(r["logical_offset"], r["seq"], r["length"]) for r in streams.newest_by_offset(spark.createDataFrame(rows, LOG)).collect()} == {(0, 1, 4), (8, 2, 4)}


def test_text_trace(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# id io offset length begin end tail\n1 w 0 10 0.5 1.5 9\n\n2 w 10 5 1.0 2.0 14\n")
    assert [tuple(r) for r in logs.read_text_trace(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == [(1, "w", 0, 10, 0.5, 1.5, 9), (2, "w", 10, 5, 1.0, 2.0, 14)]
    (tmp_path / "bad.txt").write_text("1 w 0\n")
    with pytest.raises(Exception, match="not seven fields"):
        logs.read_text_trace(spark, str(tmp_path / "bad.txt")).collect()


def test_flattened_map(spark, tmp_path):
    log = spark.createDataFrame(ROWS, LOG)
    want = sorted(map(str, resolve(log).collect()))
    assert sorted(map(str, logs.populated(spark, str(tmp_path / "flat"), log).collect())) == want
    logs.flatten(log, str(tmp_path / "flat"))
    assert sorted(map(str, logs.populated(spark, str(tmp_path / "flat"), log.where("false")).collect())) == want


def test_map_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, row in enumerate(ROWS):
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    query = streams.maintained_map(stream, str(tmp_path / "map"), str(tmp_path / "ck"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    got = streams.read_map(spark, str(tmp_path / "map"), last)
    bytes_of = lambda df: {(r["file_id"], r["logical_offset"] + k): (r["pid"], r["seq"], r["physical_offset"] + k) for r in df.collect() for k in range(r["length"])}
    assert bytes_of(got) == bytes_of(resolve(spark.createDataFrame(ROWS, LOG))) == bytes_of(streams.read_map(spark, str(tmp_path / "map")))
    assert bytes_of(streams.read_map(spark, str(tmp_path / "map"), last - 1)) == bytes_of(resolve(spark.createDataFrame(ROWS[:-1], LOG)))
    assert {r["file_id"]: r["eof"] for r in streams.read_ends(spark, str(tmp_path / "map")).collect()} == {"f": 15, "g": 4, "e": 500}


def test_running_sizes_and_windows(spark, tmp_path):
    spark.createDataFrame(ROWS, LOG).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    for frame, name, mode in ((streams.running_eof(stream), "sizes", "complete"), (streams.bandwidth_windows(stream), "windows", "complete")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {r["file_id"]: r["eof"] for r in spark.table("sizes").collect()} == {"f": 15, "g": 4, "e": 500}
    assert [(r["bytes"], r["records"]) for r in spark.table("windows").collect()] == [(28, 5)]


def test_recent_messages(spark, tmp_path):
    ship(spark)
    schema = "facility string, at long, text string"
    for k in range(3):
        spark.createDataFrame([("net", 10 * k + j, f"m{10 * k + j}") for j in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.recent_messages(stream, 5).writeStream.format("memory").queryName("ring").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("ring").collect()[-1]["texts"] == ["m13", "m20", "m21", "m22", "m23"] or any(r["texts"] == ["m13", "m20", "m21", "m22", "m23"] for r in spark.table("ring").collect())


def test_copies(spark, tmp_path):
    spark.createDataFrame(ROWS, LOG).write.parquet(str(tmp_path / "in"))
    streams.copied_files(spark, str(tmp_path / "in"), LOG, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
