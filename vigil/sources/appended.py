"""Follow text files to which lines are appended: a streaming source with byte offsets (A4).

An offset holds, for every followed file, the end of its last complete line (``at``) and two marks of the bytes before
it: its first line (``head``) and the last bytes read (``mark``). It is computed from the files alone, so a restarted query
needs nothing but its checkpoint. A micro-batch is the difference of two offsets:

* a file that has grown is read from where it ended before; a partial last line waits until its line feed is there;
* a file whose marks are no longer there, or that is shorter than before, was replaced or truncated: the new one is
  read from its start;
* a file that appears under another name with the marks of one that is gone from its old name was renamed by a
  rotation and is read on from where it ended (let the pattern cover the rotated names, as in ``auth.log*``).

Long stretches are cut into pieces of ``splitBytes``, so a backlog of any size spreads over tasks; a line belongs to the
piece that it begins in. Every line carries its file and place, which give it a deterministic id without any exchange.
Files are reached through ``pyarrow.fs`` (local and mounted paths, HDFS, object stores), by name order; compressed
files and names that begin with a dot or underscore are not followed.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vigil.sources.lines import ID_SEP, clean_lines

BLOCK = 1 << 20          # bytes read at a time
SPLIT = 64 << 20         # bytes of one task
BATCH_BYTES = 4 << 20    # text of one Arrow batch
MARK_BYTES = 256
PACKED = (".gz", ".bz2", ".xz", ".zst", ".zip")
LINES = pa.schema([("value", pa.string()), ("file_path", pa.string()), ("at", pa.int64())])


class Folder:
    """The followed files: a file, all files of a folder, or a pattern of names in a folder."""

    def __init__(self, path: str):
        root, _, name = path.rstrip("/").rpartition("/")
        pattern = name if any(c in name for c in "*?[") else None
        self.fs, self.base = fs.FileSystem.from_uri(root if pattern else path.rstrip("/"))
        self.pattern = pattern

    def files(self) -> dict[str, int]:
        """path -> size."""
        info = self.fs.get_file_info(self.base)
        if info.type == fs.FileType.File:
            return {info.path: info.size}
        found = self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return {i.path: i.size for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and self._followed(i.base_name)}

    def _followed(self, name: str) -> bool:
        return name[0] not in "._" and not name.endswith(PACKED) and (self.pattern is None or fnmatch.fnmatchcase(name, self.pattern))

    def bytes_at(self, path: str, start: int, size: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read_at(size, start)

    def last_line_end(self, path: str, size: int) -> int:
        """The place behind the last line feed before ``size``."""
        end = size
        while end > 0:
            start = max(0, end - BLOCK)
            found = self.bytes_at(path, start, end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
        return 0

    def first_line(self, path: str) -> bytes:
        return self.bytes_at(path, 0, MARK_BYTES).split(b"\n")[0]

    def mark(self, path: str, at: int) -> str:
        start = max(0, at - MARK_BYTES)
        return _digest(self.bytes_at(path, start, at - start))


def _digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()[:24]


class Piece(InputPartition):
    """Lines of ``path`` that begin in [start, stop); the stretch of the micro-batch is [first, end)."""

    def __init__(self, path: str, first: int, end: int, start: int, stop: int):
        self.path, self.first, self.end, self.start, self.stop = path, first, end, start, stop


class AppendedLines(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.from_end = options.get("start", "end") == "end"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self._known: dict[str, tuple[int, dict]] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {"files": {}}

    def latestOffset(self) -> dict:
        folder, out = Folder(self.path), {}
        for path, size in folder.files().items():
            known = self._known.get(path)
            try:
                head = _digest(folder.first_line(path))
                if known is None or known[0] != size or known[1]["head"] != head:
                    at = folder.last_line_end(path, size)
                    known = self._known[path] = size, {"at": at, "head": head, "mark": folder.mark(path, at)}
            except FileNotFoundError:  # renamed since it was listed; seen under its new name next time
                continue
            if known[1]["at"]:
                out[path] = known[1]
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        folder, before, now = Folder(self.path), start["files"], end["files"]

        def goes_on(old: dict, path: str) -> bool:
            new = now[path]
            return old["head"] == new["head"] and old["at"] <= new["at"] and (
                old == new or folder.mark(path, old["at"]) == old["mark"])

        kept = {p for p in now if p in before and goes_on(before[p], p)}
        gone = [p for p in before if p not in kept]
        out = []
        for path, new in now.items():
            first = before[path]["at"] if path in kept else 0
            if path not in kept:
                renamed = next((p for p in gone if goes_on(before[p], path)), None)
                if renamed is not None:
                    gone.remove(renamed)
                    first = before[renamed]["at"]
            out += [Piece(path, first, new["at"], a, min(a + self.split, new["at"])) for a in range(first, new["at"], self.split)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for at, line in lines_of(Folder(self.path).fs, partition):
            rows.append((line.decode("utf-8", "replace"), partition.path, at))
            size += len(line)
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LINES)], schema=LINES)


def lines_of(files: fs.FileSystem, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the piece, without their line ends."""
    with files.open_input_file(piece.path) as f:
        # a piece inside a stretch begins behind the first line feed at or after the byte before it
        skip = piece.start > piece.first
        at = pos = piece.start - 1 if skip else piece.start
        held: list[bytes] = []
        while pos < piece.end and at < piece.stop:
            block = f.read_at(min(BLOCK, piece.end - pos), pos)
            if not block:
                raise EOFError(f"{piece.path} ends at {pos}, before {piece.end}: it was cut while it was read")
            pos += len(block)
            whole, feed, rest = block.rpartition(b"\n")
            if not feed:
                held.append(block)
                continue
            for line in (b"".join(held) + whole).split(b"\n"):
                if skip:
                    skip = False
                elif at < piece.stop:
                    place = at
                    for part in line.splitlines(keepends=True):  # bytes: only carriage returns are left to split at
                        yield place, part.rstrip(b"\r")
                        place += len(part)
                else:
                    return
                at += len(line) + 1
            held = [rest]


class AppendedLinesSource(DataSource):
    """Options: ``path`` (file, folder or pattern), ``start`` (``end``, the default: only what is appended from now on, or
    ``beginning``), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "vigil_appended"

    def schema(self) -> str:
        return "value string, file_path string, at long"

    def streamReader(self, schema) -> AppendedLines:
        return AppendedLines(dict(self.options))


def follow_appended(spark: SparkSession, path: str, start: str = "end", split_bytes: int = SPLIT) -> DataFrame:
    """Stream of (value, file_path, at) of lines appended to the files of ``path``."""
    spark.dataSource.register(AppendedLinesSource)
    lines = spark.readStream.format("vigil_appended").option("path", path).option("start", start).option("splitBytes", str(split_bytes)).load()
    return clean_lines(lines)


def placed_lines(lines: DataFrame, collector: str) -> DataFrame:
    """(value, id): a line is told by its collector, file, place and text, so nothing is exchanged to number lines."""
    place = F.concat_ws(ID_SEP, F.lit(collector), F.col("file_path"), F.col("at").cast("string"), F.col("value"))
    return lines.select("value", F.sha2(place, 256).alias("id"))
