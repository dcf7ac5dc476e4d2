"""Removal of repeated passages: suffix automata of reference shards give matching statistics of streamed documents.

A window of ``window`` words is a repeat when its word sequence starts earlier: in a smaller document, or before in the same
one. Words covered by a repeat go. The reference is the whole corpus, which grows with the input, so its automata cannot be
broadcast; it is cut in shards that fit a task, and only text that can match a shard is streamed to it:

1. Every window picks the smallest of its hashed runs of GRAM words (leftmost on ties). Equal windows pick equal runs, so a
   window can only repeat where its run does. The runs are counted over all documents.
2. Runs that occur more than once set a bit in a bitmap of FILTER_BITS bits, those over HOT times in a second one. The two
   bitmaps are all that is broadcast; their size is fixed. A false bit costs work, never a result. A corpus with more
   repeated runs than a FILTER_LOAD-th of the bits (some GB of text) joins runs with documents instead, with
   the same result.
3. The stretch of text of every window that picked a set run goes to the shard of that run. A shard reads its
   stretches in document order: each is matched against the suffix automaton of what the shard has read before, and a
   matching statistic of ``window`` or more at a word marks a repeat that ends there. A stretch with a window that is
   new is then added to the automaton; equal stretches are matched once. (No stretch repeats itself: its windows hold the
   picked run at different places, and equal windows hold it at the same place.)
4. Runs over HOT times (a passage in a third of all documents) are streamed window by window: a shard is one window's
   sequence, salted by document, and the first of each salt meets the others in a second pass. So no shard grows beyond
   HOT stretches or a share of one window's copies, and its automaton stays small. Before the exchange every task
   collapses equal stretches: only the first goes to its shard, the others are known repeats.
5. The marked spans meet their documents once, by id, and the covered words are dropped.

Defined cases: null and empty texts have no words; a text shorter than the window stays whole; rows equal in id and text are one
document and get equal results; rows of one id with other texts are ordered by a hash of the text; rows without an id come
after all others; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import cut_lineage, ensure_checkpoint_dir

WINDOW = 20
GRAM = 6
FILTER_BITS = 26          # two bitmaps of 2**26 bits, 8 MB each, whatever the corpus
FILTER_LOAD = 8           # bits for each repeated run that the bitmaps must have
HOT = 256                 # occurrences of a run from which windows are dealt one by one
SALTS = 64
COLLAPSE = 60_000         # stretches that a task holds to collapse equal ones before it sends them
SPAN_ROW = -2
EMIT_ROWS = 5_000
MIX = np.uint64(0xFF51AFD7ED558CCD)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only ASCII blanks split


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def run_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * STEP + h[i:len(words) - n + 1 + i]
    return mixed(out)


def picked(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run hash, first window, last window) of the runs that windows pick, in order; windows of one pick are consecutive."""
    runs = run_hashes(words, gram)
    views = np.lib.stride_tricks.sliding_window_view(runs, window - gram + 1)
    at = np.concatenate([views[i:i + 65536].argmin(axis=1) for i in range(0, len(views), 65536)]) + np.arange(len(views))
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return runs[at[first]], first, np.concatenate([first[1:] - 1, [len(at) - 1]])


# ---------------------------------------------------------------- which runs repeat

def count_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(run, n): occurrences of every picked run, pre-counted in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for t in b.column(0):
                words = words_of(t.as_py())
                if len(words) >= window:
                    held.append(picked(words, window, gram)[0])
            if held:
                value, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["run", "n"])

    return docs.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def bitmaps(counts: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the runs that occur twice or more, and of those that occur over ``hot`` times: at most 2**(bits-6) rows
    of 64 bits reach the driver, whatever the corpus."""
    bit = F.shiftrightunsigned("run", 64 - bits)
    words = (counts.where("n > 1").select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(run, {64 - bits}) & 63 as int))").alias("bit"), "n")
             .groupBy("word").agg(F.bit_or("bit").alias("any"), F.bit_or(F.when(F.col("n") > hot, F.col("bit"))).alias("hot")))
    got = words.toArrow()
    any_, hot_ = np.zeros(1 << (bits - 6), np.uint64), np.zeros(1 << (bits - 6), np.uint64)
    at = got.column("word").to_numpy()
    any_[at] = got.column("any").to_numpy().astype(np.int64).view(np.uint64)
    hot_[at] = got.column("hot").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    return any_, hot_


def is_set(bitmap: np.ndarray, run: np.ndarray, bits: int) -> np.ndarray:
    bit = run >> np.uint64(64 - bits)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def with_repeated_runs(docs: DataFrame, counts: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """``docs`` that hold a repeated run, with the arrays ``repeated`` and ``often`` of their own such runs: joins on
    the run and on the document, for corpora whose repeated runs outgrow the bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, t in enumerate(b.column("text")):
                words = words_of(t.as_py())
                if len(words) >= window:
                    own.append(np.unique(picked(words, window, gram)[0]))
                    at.append(np.full(len(own[-1]), i))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own).view(np.int64)), *(b.column(c).take(rows) for c in DOC)], names=["run", *DOC])

    held = docs.select(*DOC, "text").mapInArrow(run, "run long, did long, late boolean, content long")
    repeated = counts.where("n > 1").select("run", (F.col("n") > hot).alias("hot"))
    own = held.join(repeated, "run").groupBy(*DOC).agg(  # at most the runs of one document
        F.collect_list("run").alias("repeated"), F.collect_list(F.when(F.col("hot"), F.col("run"))).alias("often"))
    return docs.join(own, DOC)


# ---------------------------------------------------------------- stretches

DOC = ["did", "late", "content"]
STRETCH = "key long, salt int, late boolean, did long, content long, start int, n int, words binary"
ORDER = ["key", "salt", "late", "did", "content", "start"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in STRETCH.split(", ")])


def stretches(docs: DataFrame, shared, window: int, gram: int, bits: int, collapse: int = COLLAPSE) -> DataFrame:
    """Text of every window whose run may repeat, keyed by the shard it goes to. Which runs those are says the pair of
    broadcast bitmaps, or where ``shared`` is None the columns ``repeated`` and ``often`` of each document. Equal stretches that a task meets are
    collapsed before the exchange: the first in document order goes to its shard, the others are repeats of it and
    travel as spans without text (salt SPAN_ROW, dealt by document)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_, hot_ = shared.value if shared else (None, None)
        first: dict[tuple[int, bytes], tuple] = {}
        spans: list[tuple] = []

        def meet(key: int, salt: int, place: tuple, n: int, raw: bytes) -> None:
            met = first.setdefault((key, raw), (place, salt, n))
            if met[0] != place:  # equal places: the same document again
                if place < met[0]:
                    first[key, raw] = (place, salt, n)
                    place = met[0]
                late, did, content, start = place
                spans.append((did, SPAN_ROW, late, did, content, start, n + window - 1, None))

        def emptied() -> Iterator[pa.RecordBatch]:
            rows = [(key, salt, *place, n, raw) for (key, raw), (place, salt, n) in first.items()] + spans
            first.clear()
            spans.clear()
            for at in range(0, len(rows), EMIT_ROWS):
                yield batch_of(rows[at:at + EMIT_ROWS])

        for b in batches:
            for at, (late, did, content, text) in enumerate(zip(*(b.column(c) for c in ("late", "did", "content", "text")))):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                key, begin, last = picked(words, window, gram)
                if shared:
                    may = np.nonzero(is_set(any_, key, bits))[0]
                    hot = is_set(hot_, key[may], bits)
                else:
                    may = np.nonzero(np.isin(key.view(np.int64), b.column("repeated")[at].values.to_numpy()))[0]
                    hot = np.isin(key[may].view(np.int64), b.column("often")[at].values.to_numpy())
                if not len(may):
                    continue
                late, did, content = late.as_py(), did.as_py(), content.as_py()
                salt = (content ^ did) % SALTS
                for k, a, z, many in zip(key[may].view(np.int64).tolist(), begin[may].tolist(), last[may].tolist(), hot.tolist()):
                    if not many:
                        meet(k, -1, (late, did, content, a), z - a + 1, b" ".join(words[a:z + window]))
                        continue
                    for s in range(a, z + 1):
                        one = b" ".join(words[s:s + window])
                        meet(xxhash.xxh64_intdigest(one) - (1 << 63), salt, (late, did, content, s), 1, one)
                if len(first) + len(spans) >= collapse:
                    yield from emptied()
        yield from emptied()

    columns = ["late", "did", "content", "text"] + ([] if shared else ["repeated", "often"])
    return docs.select(*columns).mapInArrow(run, STRETCH)


# ---------------------------------------------------------------- suffix automaton

class SuffixAutomaton:
    """Automaton of all factors of the word sequences added so far."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        """The state of length[p] + 1 that reads c after p; q is copied if it stands for longer factors too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for c in words:
            p = last
            if c in self.next[p]:
                last = self._split(p, c, self.next[p][c])
                continue
            new = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def matches(self, words: list[bytes], window: int) -> list[bool]:
        """For each window of ``words``: does the longest match that ends with it span it?"""
        out, v, n = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for c in words:
            while v and c not in nexts[v]:
                v = link[v]
                n = length[v]
            if c in nexts[v]:
                v = nexts[v][c]
                n += 1
            else:
                n = 0
            out.append(n >= window)
        return out[window - 1:]


FOUND = "survives boolean, key long, late boolean, did long, content long, start int, n int, words binary"


def match_shards(dealt: DataFrame, window: int) -> DataFrame:
    """Stream every shard's stretches, in document order, against the automaton of what it has read. Rows of the result:
    spans of words to remove, and (``survives``) windows of salted shards that were new there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = before = None
        rows: list[tuple] = []
        for b in batches:
            for key, salt, late, did, content, start, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if salt == SPAN_ROW:
                    rows.append((False, key, late, did, content, start, n, None))
                    continue
                if (key, salt) != shard:
                    shard, before, automaton, seen, pending = (key, salt), None, None, set(), []
                place = (late, did, content, start, raw)
                if place == before:  # the same document again
                    continue
                before = place
                if raw in seen:
                    rows.append((False, key, late, did, content, start, n + window - 1, None))
                    continue
                words = raw.split(b" ")
                repeat = [False] * n
                if pending:
                    automaton = automaton or SuffixAutomaton()
                    for w in pending:
                        automaton.add(w)
                    pending = []
                if automaton is not None:
                    repeat = automaton.matches(words, window)
                i = 0
                while i < n:
                    j = i
                    while j < n and repeat[j] == repeat[i]:
                        j += 1
                    if repeat[i]:
                        rows.append((False, key, late, did, content, start + i, j - i + window - 1, None))
                    i = j
                if not all(repeat):
                    pending.append(words)
                    seen.add(raw)
                    if salt >= 0:
                        rows.append((True, key, late, did, content, start, n, raw))
            if len(rows) >= EMIT_ROWS:
                yield found_batch(rows)
                rows = []
        yield found_batch(rows)

    return dealt.mapInArrow(run, FOUND)


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])


# ---------------------------------------------------------------- operator

def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the place of a row in the order of documents."""
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("late"),
                     F.coalesce(F.col(id_col).cast("long"), content).alias("did"), content.alias("content"))


def shared_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS, hot: int = HOT,
                   load: int = FILTER_LOAD) -> DataFrame:
    """(late, did, content, start, n): spans of words covered by repeats; spans may overlap."""
    spark = docs.sparkSession
    counts = cut_lineage(count_runs(docs, window, gram).where("n > 1"))
    if counts.count() * load <= 1 << bits:
        shared = spark.sparkContext.broadcast(bitmaps(counts, bits, hot))
        dealt = stretches(docs, shared, window, gram, bits)
    else:
        dealt = stretches(with_repeated_runs(docs, counts, window, gram, hot), None, window, gram, bits)
    first = match_shards(dealt.repartition("key", "salt").sortWithinPartitions(*ORDER), window)
    path = shared_folder(spark)
    first.write.parquet(path)  # read twice below: spans, and windows that meet the other salts
    first = spark.read.schema(FOUND).parquet(path)
    again = first.where("survives").select("key", F.lit(-1).alias("salt"), "late", "did", "content", "start", "n", "words")
    second = match_shards(again.repartition("key").sortWithinPartitions(*ORDER), window)
    spans = ["late", "did", "content", "start", "n"]
    return first.where("not survives").select(*spans).union(second.where("not survives").select(*spans))


def with_spans(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    docs = identified(df, id_col, text_col)
    spans = repeated_spans(docs, **kw).groupBy(*DOC).agg(  # at most one entry a window of the document
        F.collect_list((F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")).alias("span")).alias("spans"))
    return docs.join(spans, DOC, "left")


def keep_mask(n_words: int, spans: np.ndarray | None) -> np.ndarray:
    """True for words outside all spans (start in the high half, length in the low half of each number)."""
    if spans is None or not n_words:
        return np.ones(n_words, bool)
    start, n = spans >> 32, spans & 0xFFFFFFFF
    edge = np.bincount(start, minlength=n_words + 1) - np.bincount(start + n, minlength=n_words + 1)
    return np.cumsum(edge)[:n_words] == 0


RESULT = "n_words long, n_removed long, kept string, removed array<struct<start:int,n:int>>"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id, n_words, n_removed, kept, removed): the kept words joined by blanks, and the removed spans in words."""
    both = with_spans(df, id_col, text_col, **kw)
    schema = both.select(F.col("id").alias(id_col)).schema.simpleString()[7:-1] + ", " + RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans")):
                words = words_of(text.as_py())
                keep = keep_mask(len(words), spans.values.to_numpy() if spans.is_valid else None)
                turn = np.nonzero(np.diff(np.concatenate([[True], keep, [True]])))[0].tolist()
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode())
                removed.append([{"start": a, "n": z - a} for a, z in zip(turn[::2], turn[1::2])])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
                names=[id_col, "n_words", "n_removed", "kept", "removed"])

    return both.select("id", "text", "spans").mapInArrow(run, schema)


def op1(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    return remove_repeats(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
