"""Benchmark decontamination by a prefix-filtered set join, verified exactly.

Every benchmark item is cut in windows of WINDOW consecutive words (a shorter item is one window). A window
occurs in a document only if all of its word shingles do, so at a containment of 1 the necessary prefix of a
window is a single shingle. Shingles are ordered by rarity, counted over all documents, and the
rarest of a window is its prefix token: documents meet a window only through that token. A meeting
at document position p of a token at offset o of a window of length n passes the positional bound if
p - o >= 0 and the length bound if p - o + n <= words of the document; then all n words are compared.

The index of windows goes to the tasks as Spark broadcasts of bounded size: the item words are cut in parts of
at most PART_WORDS words, one broadcast and one pass over the documents each (a usual benchmark is one part), so
a benchmark of any size is handled whole and a task never holds more than one part. Texts are
never shuffled: a pass emits a document's hit spans and item ids, one row a document.

Defined cases: null and empty texts have no words, no hits and no items; items without words have no windows;
items with equal texts are all reported; repeated documents are each reported; items without an id hit words like any
other and count as one item, which has no name to list; an empty benchmark or documents table works; extra columns pass unchanged (those named
like a result column are replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import shielded

WINDOW = 13
SHINGLE = 3
PART_WORDS = 250_000   # about 200 MB in a worker
MIX = np.uint64(0x9E3779B97F4A7C15)

# Word bytes: digits, letters (lower-cased) and everything beyond ASCII; the rest separates.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def mixed(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value of every run of ``n`` ids, for lookup only (matches are verified on the ids)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ ids[i:len(ids) - n + 1 + i].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


class Part:
    """Windows of some benchmark items, their vocabulary and, once counted, their prefix tokens."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item_id, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for s in range(max(1, len(ids) - window + 1)):
                self.windows[tuple(ids[s:s + window])].add(item_id)
        self.shingle = shingle
        #: shingle length by window length: a window shorter than a shingle is its own shingle
        self.lengths = sorted({min(len(w), shingle) for w in self.windows})
        self.tokens: dict[int, np.ndarray] = {
            n: np.unique(np.concatenate([mixed(np.array(w), n) for w in self.windows if min(len(w), shingle) == n]))
            for n in self.lengths}

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def seen(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document of shingles of the part, and their places in ``tokens[n]``."""
        if len(ids) < n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        whole = known[:len(ids) - n + 1].copy()
        for i in range(1, n):
            whole &= known[i:len(ids) - n + 1 + i]
        at = np.nonzero(whole)[0]
        if not len(at):
            return at, at
        value = np.zeros(len(at), np.uint64)
        for i in range(n):
            value = (value ^ ids[at + i].astype(np.uint64)) * MIX
            value ^= value >> np.uint64(29)
        tokens = self.tokens[n]
        place = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
        hit = tokens[place] == value
        return at[hit], place[hit]

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Prefix token of every window: its rarest shingle (ties: the smaller value, then the earlier offset)."""
        self.prefix: dict[int, dict[int, list]] = {n: defaultdict(list) for n in self.lengths}
        for w, names in self.windows.items():
            n = min(len(w), self.shingle)
            value = mixed(np.array(w), n)
            place = np.searchsorted(self.tokens[n], value)
            o = min(range(len(value)), key=lambda i: (counts[n][place[i]], int(value[i]), i))
            self.prefix[n][int(place[o])].append((o, np.array(w), names))
        self.wanted = {n: np.isin(np.arange(len(self.tokens[n])), list(self.prefix[n])) for n in self.lengths}

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(start, length, item ids) of every window that occurs in the document."""
        ids = self.ids_of(words)
        for n in self.lengths:
            at, place = self.seen(ids, n)
            if len(at):
                wanted = self.wanted[n][place]
                for p, t in zip(at[wanted].tolist(), place[wanted].tolist()):
                    for o, w, names in self.prefix[n][t]:
                        s = p - o
                        if s >= 0 and s + len(w) <= len(ids) and np.array_equal(ids[s:s + len(w)], w):
                            yield s, len(w), names


def count_shingles(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """Occurrences over all documents of every shingle of the part; a task sends one row a shingle it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        total = {n: np.zeros(len(part.tokens[n]), np.int64) for n in part.lengths}
        for b in batches:
            for t in b.column(0):
                ids = part.ids_of(words_of(t.as_py()))
                for n in part.lengths:
                    total[n] += np.bincount(part.seen(ids, n)[1], minlength=len(total[n]))
        for n, c in total.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int64)), pa.array(at), pa.array(c[at])], names=["len", "place", "n"])

    part = shared.value
    counts = {n: np.zeros(len(part.tokens[n]), np.int64) for n in part.lengths}
    found = docs.mapInArrow(run, "len long, place long, n long").groupBy("len", "place").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():  # at most the shingles of one part
        counts[r["len"]][r["place"]] = r["n"]
    return counts


def parts_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int, part_words: int) -> Iterator[Part]:
    """The items in parts of bounded size, read part by part; a single longer item is a part of its own."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        if held and size + len(words) > part_words:
            yield Part(held, window, shingle)
            held, size = [], 0
        if words:
            held.append((r["id"], words))
            size += len(words)
    if held:
        yield Part(held, window, shingle)


HITS = "n_words long, spans array<struct<start:int,length:int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, part_words: int = PART_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged runs of hit words), ``items`` (ids of items with occurring windows),
    ``n_hit`` and ``contaminated`` (hit words are at least a twentieth). With ``keep_text`` false the text column goes."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items", "n_hit", "contaminated")]
    extra = T._parse_datatype_string(HITS).fields
    out = docs.select(*keep, F.lit(0).cast("long").alias("n_words"),
                      F.lit(None).cast("array<struct<start:int,length:int>>").alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))
    schema = T.StructType([docs.schema[c] for c in keep] + extra)
    parts = 0
    for part in parts_of(benchmark, item_id, item_text, window, shingle, part_words):
        shared = spark.sparkContext.broadcast(part)
        part.index(count_shingles(docs.select(text_col), shared))
        shared.unpersist()
        out = mark(out, spark.sparkContext.broadcast(part), text_col, schema)
        parts += 1
    if not parts:
        out = mark(out, spark.sparkContext.broadcast(Part([], window, shingle)), text_col, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    return out if keep_text else out.drop(text_col)


def mark(docs: DataFrame, shared, text_col: str, schema: T.StructType) -> DataFrame:
    """One pass: the spans and items of one part joined to those found before."""
    names = [f.name for f in schema.fields]
    keep = names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for b in batches:
            n_words, spans, items = [], [], []
            before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist())
            for t, (old_spans, old_items) in zip(b.column(text_col), before):
                words = words_of(t.as_py())
                hit = np.zeros(len(words) + 1, np.int8)
                names_found = set(old_items or ())
                for s in old_spans or ():
                    hit[s["start"]:s["start"] + s["length"]] = 1
                for s, n, names_ in part.occurrences(words):
                    hit[s:s + n] = 1
                    names_found.update(names_)
                turn = np.nonzero(np.diff(hit, prepend=0))[0].tolist()
                n_words.append(len(words))
                spans.append([{"start": a, "length": e - a} for a, e in zip(turn[::2], turn[1::2])])
                items.append(sorted(names_found, key=lambda i: (i is None, i)))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep]
                + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                names=names)

    return docs.mapInArrow(run, schema)


def op3(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows. Item ids sorted as strings; the empty list gives the digest of no bytes."""
    found = contamination(documents.select("doc_id", "text"), benchmark, keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``documents`` that are not contaminated; all their columns stay as they are."""
    return shielded(documents, ["doc_id", "text"], lambda d: contamination(d, benchmark).where(~F.col("contaminated")))
