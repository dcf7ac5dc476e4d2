"""Lines appended to followed files arrive once: growth, partial lines, rotation, truncation, restart, pieces."""

import os
import random

import pytest

from vigil.sources.appended import AppendedLines, Folder, follow_appended, lines_of


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode() if isinstance(text, str) else text)


def read(reader, start, end):
    files = Folder(reader.path).fs
    return [(os.path.basename(p.path), at, line) for p in reader.partitions(start, end) for at, line in lines_of(files, p)]


def texts(rows):
    return [line.decode() for _, _, line in rows]


def test_growth_partial_lines_and_start(tmp_dir):
    append(f"{tmp_dir}/a.log", "old\npart")
    tail = AppendedLines({"path": tmp_dir})
    start = tail.initialOffset()
    append(f"{tmp_dir}/a.log", "ial\nnew")
    append(f"{tmp_dir}/b.log", "none yet")
    one = tail.latestOffset()
    assert texts(read(tail, start, one)) == ["partial"]  # what was there before the start is not read, the open line is
    append(f"{tmp_dir}/a.log", "er\r\nx\ry\n\n")
    append(f"{tmp_dir}/b.log", "\n")
    two = tail.latestOffset()
    assert texts(read(tail, one, two)) == ["newer", "x", "y", "none yet"]
    assert read(tail, two, tail.latestOffset()) == []
    fresh = AppendedLines({"path": tmp_dir, "start": "beginning"})
    assert texts(read(fresh, fresh.initialOffset(), fresh.latestOffset())) == ["old", "partial", "newer", "x", "y", "none yet"]


def test_rotation_and_truncation(tmp_dir):
    tail = AppendedLines({"path": f"{tmp_dir}/auth.log*", "start": "beginning"})
    append(f"{tmp_dir}/auth.log", "a1\na2\n")
    append(f"{tmp_dir}/other.txt", "no\n")
    append(f"{tmp_dir}/auth.log.2.gz", b"\x1f\x8b\n")
    one = tail.latestOffset()
    assert texts(read(tail, tail.initialOffset(), one)) == ["a1", "a2"]
    append(f"{tmp_dir}/auth.log", "a3\n")  # written before the rotation, not seen yet
    os.rename(f"{tmp_dir}/auth.log", f"{tmp_dir}/auth.log.1")
    append(f"{tmp_dir}/auth.log", "b1\n")
    two = tail.latestOffset()
    assert sorted(texts(read(tail, one, two))) == ["a3", "b1"]
    append(f"{tmp_dir}/auth.log", "b2\n")
    three = tail.latestOffset()
    assert texts(read(tail, two, three)) == ["b2"]
    with open(f"{tmp_dir}/auth.log", "wb") as f:  # truncated in place, then longer than before
        f.write(b"c1 " + b"x" * 50 + b"\nc2\n")
    four = tail.latestOffset()
    assert texts(read(tail, three, four)) == ["c1 " + "x" * 50, "c2"]
    with open(f"{tmp_dir}/auth.log", "wb") as f:  # the same first line, other lines behind it
        f.write(b"c1 " + b"x" * 50 + b"\nc3\nc4\n")
    five = tail.latestOffset()
    assert texts(read(tail, four, five)) == ["c1 " + "x" * 50, "c3", "c4"]
    os.remove(f"{tmp_dir}/auth.log")
    assert read(tail, five, tail.latestOffset()) == []
    again = AppendedLines({"path": f"{tmp_dir}/auth.log*"})  # a restarted reader plans a micro-batch from the offsets alone
    assert again.partitions(four, four) == []


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_pieces_cover_every_line_once(tmp_dir, split):
    r = random.Random(split)
    lines = ["".join(r.choice("abé漢 ") for _ in range(r.choice([0, 1, 5, 300]))) for _ in range(200)]
    append(f"{tmp_dir}/a.log", "\n".join(lines) + "\nopen end")
    tail = AppendedLines({"path": f"{tmp_dir}/a.log", "start": "beginning", "splitBytes": str(split)})
    end = tail.latestOffset()
    got = read(tail, tail.initialOffset(), end)
    raw = open(f"{tmp_dir}/a.log", "rb").read()
    assert texts(got) == [x for x in lines if x] and all(raw[at:at + len(line)] == line for _, at, line in got)


def test_missing_folder_and_bytes_that_are_no_text(tmp_dir):
    tail = AppendedLines({"path": f"{tmp_dir}/none"})
    assert tail.initialOffset() == {"files": {}}
    append(f"{tmp_dir}/a.log", b"\xff\xfe line\n")
    tail = AppendedLines({"path": f"{tmp_dir}/a.log", "start": "beginning"})
    batch, = [b for p in tail.partitions(tail.initialOffset(), tail.latestOffset()) for b in tail.read(p)]
    assert batch.column("value").to_pylist() == ["�� line"]


def test_stream_of_appended_lines_over_restarts(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    append(f"{tmp_dir}/in/a.log", "before\n")

    def run():
        q = (follow_appended(spark, f"{tmp_dir}/in", split_bytes=8).writeStream.format("parquet").option("checkpointLocation", f"{tmp_dir}/ck")
             .option("path", f"{tmp_dir}/out").trigger(processingTime="0 seconds").start())
        try:
            q.processAllAvailable()
            append(f"{tmp_dir}/in/a.log", "  one \npart")
            append(f"{tmp_dir}/in/b.log", "two\n\n")
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    append(f"{tmp_dir}/in/a.log", "ed while stopped\n")
    run()
    got = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted(r["value"] for r in got.collect()) == ["one", "one", "parted while stopped", "two", "two"]
    assert got.select("file_path", "at").distinct().count() == 5
