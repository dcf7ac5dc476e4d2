"""Histogram sort: near-equal shards by bytes, found by counting and built with one exchange.

Rows are ordered by a hex key (hash of the text, then hash of the id), so equal texts lie side by
side and no single text or id decides a shard's size. The splitters are found before any row moves:
every round counts the exact bytes and rows below candidate boundaries (key prefixes) across all
partitions, keeps each boundary that is within tolerance of its target, and probes finer prefixes
only around the others. One exchange then sends each row to its range. A shard is cut in as many
ranges as its rows need, so no task grows with the input; a row's slot is the count of rows of
the shard below its range (known from the histogram) plus its place in the range.

The driver sees only histograms: at most 4096 counts in the first round and 256 for each open
splitter in a later one, whatever the number of rows. DataFrame functions only.

A key that holds more rows than a splitter tolerates (rows equal in text and id) is cut among its rows: these alone are
numbered, stored once so that the numbers last, and their numbers are further digits of the key for the same probes.

Defined cases: null text has no bytes and the CRC of no bytes; null ids hash like a value; rows equal
in text and id share a shard unless a boundary falls among them; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.llm.common import cut_lineage, hex64, literal

FIRST_DIGITS = 3          # 4096 probes over the whole key space
NEXT_DIGITS = 2           # 256 probes in each open interval
TOLERANCE = 0.0005        # of a shard's bytes, for the splitters between shards
RANGE_ROWS = 4_000_000    # rows of one range inside a shard (its splitters may be off by a quarter)
AFTER = "~"               # sorts after every hex digit: prefix + AFTER follows all keys of that prefix


@dataclass
class Splitter:
    target: float
    tolerance: float
    prefix: str = ""
    below: int = 0            # exact bytes below the open interval
    rows_below: int = 0
    cut: str | None = None    # keys >= cut lie above the splitter
    tied: bool = False        # the target lies among rows of one key, ``prefix``

    def settle(self, cut: str, rows: int) -> None:
        self.cut, self.rows_below = cut, rows

    def refine(self, cells: list) -> None:
        """Walk the counts of the open interval in key order to the cell that holds the target."""
        at, rows = self.below, self.rows_below
        for cell in cells:
            if at + cell["bytes"] < self.target:
                at, rows = at + cell["bytes"], rows + cell["n"]
                continue
            low, high = self.target - at, at + cell["bytes"] - self.target
            if min(low, high) <= self.tolerance or cell["n"] == 1:
                if low <= high:
                    self.settle(cell["cell"], rows)
                else:
                    self.settle(cell["cell"] + AFTER, rows + cell["n"])
            else:
                self.prefix, self.below, self.rows_below = common(cell["lo"], cell["hi"]), at, rows
                self.tied = cell["lo"] == cell["hi"]
            return
        self.settle((cells[-1]["cell"] if cells else self.prefix) + AFTER, rows)


def common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def histogram(narrow: DataFrame, open_prefixes: list[str], digits: int) -> dict[str, list]:
    """Exact bytes and rows of every probe cell under the open prefixes, by one counted pass."""
    by_length: dict[int, list[str]] = {}
    for p in open_prefixes:
        by_length.setdefault(len(p), []).append(p)
    key = F.col("__key")
    cell = reduce(
        lambda c, kv: F.when(F.substring(key, 1, kv[0]).isin(kv[1]), F.substring(key, 1, kv[0] + digits)).otherwise(c)
        if kv[0] else F.substring(key, 1, digits),
        sorted(by_length.items()), F.lit(None).cast("string"))
    counted = (
        narrow.select(cell.alias("cell"), "__key", "__size").where(F.col("cell").isNotNull())
        .groupBy("cell").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                             F.min("__key").alias("lo"), F.max("__key").alias("hi"))
        .collect())
    counted.sort(key=lambda r: r["cell"])
    return {p: [r for r in counted if r["cell"].startswith(p)] for p in open_prefixes}


def first_splitters(narrow: DataFrame, n_shards: int, tolerance: float, range_rows: int) -> tuple[list[Splitter], int]:
    """The splitters of all ranges after the probes over the whole key space, and the ranges of one shard."""
    first = histogram(narrow, [""], FIRST_DIGITS)[""]
    total, rows = sum(r["bytes"] for r in first), sum(r["n"] for r in first)
    per = max(1, -(-rows // (n_shards * range_rows)))
    share = total / n_shards
    cuts = [Splitter(total * i / (n_shards * per), share * (tolerance if i % per == 0 else 0.25 / per))
            for i in range(1, n_shards * per)]
    for s in cuts:
        s.refine(first)
    return cuts, per


def narrow_down(cuts: list[Splitter], narrow: DataFrame) -> None:
    """Probe on until every splitter is settled or known to lie among the rows of one key."""
    while open_ := [s for s in cuts if s.cut is None and not s.tied]:
        cells = histogram(narrow, sorted({s.prefix for s in open_}), NEXT_DIGITS)
        for s in open_:
            s.refine(cells[s.prefix])


def in_order(cuts: list[Splitter]) -> None:
    """Splitters settle each on its own; equal or crossing cuts inside one cell keep key order."""
    order = sorted((s.cut, s.rows_below) for s in cuts)
    for s, (cut, below) in zip(cuts, order):
        s.settle(cut, below)


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of cuts at or below the key: a table by the first digits, then the few cuts that share them."""
    cells = 16 ** FIRST_DIGITS
    first, at = [0] * (cells + 1), 0
    for b in range(cells):
        while at < len(cuts) and cuts[at][:FIRST_DIGITS] < f"{b:0{FIRST_DIGITS}x}":
            at += 1
        first[b] = at
    first[cells] = len(cuts)
    lows, all_cuts = literal(first, "array<int>"), literal(cuts, "array<string>")
    b = F.conv(F.substring(key, 1, FIRST_DIGITS), 16, 10).cast("int")
    low, high = F.get(lows, b), F.get(lows, b + 1)
    return (low + F.size(F.filter(F.slice(all_cuts, low + 1, high - low), lambda c: c <= key))).cast("int")


def histogram_shards(df: DataFrame, *, text: Column, doc_id: Column, size: Column, n_shards: int = 40,
                     tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, near-equal sums of ``size``) and ``slot`` (0, 1, ... in each)."""
    key = F.concat(hex64(F.xxhash64(text)), hex64(F.xxhash64(doc_id)))
    keyed = df.withColumns({"__key": key, "__size": F.coalesce(size.cast("long"), F.lit(0))})
    narrow = cut_lineage(keyed.select("__key", "__size"))
    cuts, per = first_splitters(narrow, n_shards, tolerance, range_rows)
    narrow_down(cuts, narrow)
    if tied := sorted({s.prefix for s in cuts if s.tied}):
        among = F.col("__key").isin(tied)
        numbered = cut_lineage(keyed.where(among).withColumn("__key", F.concat("__key", hex64(F.monotonically_increasing_id()))))
        for s in cuts:
            s.tied = False
        narrow_down(cuts, numbered.select("__key", "__size"))
        keyed = keyed.where(~among).union(numbered)
    in_order(cuts)
    below = [0] + [s.rows_below for s in cuts]
    offsets = [below[i] - below[i - i % per] for i in range(n_shards * per)]
    placed = (
        keyed.withColumn("__range", range_of(F.col("__key"), [s.cut for s in cuts]))
        .repartitionById(n_shards * per, "__range"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__key"))
    return (
        placed.withColumn("slot", F.get(literal(offsets, "array<bigint>"), F.col("__range")) + place.cast("long") - 1)
        .withColumn("shard", F.floor(F.col("__range") / per).cast("int"))
        .drop("__key", "__size", "__range"))


def op6(documents: DataFrame) -> DataFrame:
    """The contract's digest: law ``bytes`` over all documents, 40 shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("__content"))
    out = histogram_shards(rows, text=F.col("__content"), doc_id=F.col("doc_id"), size=F.col("size"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
