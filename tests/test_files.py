"""Sectioned text and lines that come as they are read, against brute force."""

from __future__ import annotations

import io
import random
import socket
import threading
import time
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.plans import catalogue
from glyphmill.sources import files


def _sections(rows, indent=""):
    groups = defaultdict(list)
    for g, i in rows:
        groups[g].append(i)
    low = lambda x: (x is not None, x or "")
    return [x for g in sorted(groups, key=low) for x in [f"{g or ''}:", *[indent + (i or "") for i in sorted(groups[g], key=low)]]]


def _read(path: Path) -> list[str]:
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*"))).split("\n")[:-1]


def test_sections_equal_brute_force(spark, tmp_path):
    pick = random.Random(3)
    # one group holds most rows; ties, repeated rows, null groups and items
    rows = [(pick.choice(["hot"] * 8 + ["a", None, "z"]), pick.choice([None, "", *[f"i{k}" for k in range(300)]])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, i string").repartition(5)
    files.write_sections(df, str(tmp_path / "out"), "g", "i", indent="  ")
    assert _read(tmp_path / "out") == _sections(rows, "  ")
    sizes = [len(p.read_text().split("\n")) for p in (tmp_path / "out").glob("part-*")]
    assert len(sizes) > 1 and max(sizes) < 2 * len(rows) / 8
    lines = files.section_lines(df, "g", "i").orderBy("place").collect()
    assert [r.place for r in lines] == list(range(1, 6001)) and "\n".join(r.line for r in lines).split("\n") == _sections(rows)
    files.write_sections(df.limit(0), str(tmp_path / "none"), "g", "i")
    assert _read(tmp_path / "none") == []


def test_sections_of_repeated_parts(spark):
    """Sixty copies of the parts: the lines of the query's SQL where the key of the part closes the ties that it leaves open."""
    path = "/root/testdata/sf0.001/part.parquet"
    part = spark.read.parquet(path).crossJoin(spark.range(60)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 1_000_000).drop("id")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT p.* REPLACE (p_partkey + k * 1000000 AS p_partkey) FROM '{path}' p, range(60) r(k)")
    closed = catalogue.ORACLES["part_sections"].replace("p_name)", "p_name, p_partkey)")
    assert closed.count("p_name, p_partkey)") == 2
    got = sorted(map(tuple, catalogue.part_sections(part).select("place", "line").collect()))
    assert got == sorted(con.sql(closed).fetchall())


def test_batches_of_lines():
    assert list(files.in_batches(["a\n", "\n", "b", "c\n"], most=2, seconds=5)) == [["a", "b"], ["c"]]
    assert list(files.in_batches([])) == []

    def slow():
        yield "a"
        time.sleep(1.5)
        yield "b"

    assert list(files.in_batches(slow(), seconds=0.2)) == [["a"], ["b"]]  # the first is not held back by the second

    def broken():
        yield "a"
        raise OSError("gone")

    found = files.in_batches(broken())
    assert next(found) == ["a"]
    with pytest.raises(OSError, match="gone"):
        next(found)


def test_spool_is_read_as_stream_and_goes_on(spark, tmp_path):
    path, out, seen = str(tmp_path / "spool"), str(tmp_path / "out"), str(tmp_path / "seen")
    files.spool(spark, (f"line {k}\n" for k in range(7)), path, most=3)
    run = lambda: files.stream_spool(spark, path).writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    run()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(k, f"line {k}") for k in range(7)]
    spark.createDataFrame([(7, "later")], "n long, text string").write.mode("append").parquet(path)
    run()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == list(range(8))
    assert spark.read.parquet(files.spool(spark, [])).count() == 0


def test_command_reads_stdin(spark, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("hello\n\nworld\n"))
    cli.main(["transliterate", "name", "--id", "Latin-Cyrillic"])
    assert capsys.readouterr().out.split() == ["хелло", "уорлд"]
    monkeypatch.setattr("sys.stdin", io.StringIO("b\na\nb\n"))
    cli.main(["sort", "unique"])
    assert capsys.readouterr().out.split() == ["a", "b"]
    monkeypatch.setattr("sys.stdin", io.StringIO("a\n"))
    with pytest.raises(SystemExit):
        cli.main(["bidi", "check"])


def test_lines_of_a_socket(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:  # Spark connects to look at the source before it reads it
            try:
                taken, _ = server.accept()
                taken.sendall("one\n\nдва\n".encode())
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    query = files.socket_lines(spark, *server.getsockname()).writeStream.format("memory").queryName("socket_lines_seen").start()
    try:
        until = time.monotonic() + 30
        while spark.table("socket_lines_seen").count() < 2 and time.monotonic() < until:
            time.sleep(0.2)
        rows = spark.table("socket_lines_seen").collect()
        assert sorted(r.text for r in rows) == ["one", "два"] and all(r.timestamp for r in rows)
    finally:
        query.stop()
        server.close()
