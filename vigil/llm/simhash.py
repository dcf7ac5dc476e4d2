"""SimHash near-duplicates: fingerprints, links within a Hamming radius by anchor-point covering, components.

Anchors. A covering code of the 64-bit space is the direct sum of block codes: blocks of 7 bits use the
Hamming code (radius 1), the last bit stands for itself. A fingerprint's home is the anchor made of the
nearest code word of every block. Two fingerprints at most ``t`` bits apart have a midpoint at most
``(t+1)//2`` bits from either, and both lie within covering radius plus that distance of the midpoint's
home. So a fingerprint is replicated to the homes of all points within ``(t+1)//2`` bits (about 26 anchors at
t = 2: those within covering radius plus threshold that a link can need), and every linked pair
meets at an anchor. With 2**37 anchors a bucket holds what is truly close, at any corpus size.

Buckets. Copies are collapsed first: only distinct fingerprints are replicated. Rows are dealt by
(anchor, tile pair): a bucket of up to TILE rows is one tile; a larger one is cut into tiles by a hash and
every pair of tiles is its own task group, so no group is held whole. In a group all pairs are compared by
vector operations and only links between parts not yet joined in the group are emitted (a spanning forest), so
thousands of near copies give thousands of links, not millions.

Components. Label contraction on DataFrames: every round joins each fingerprint to the smallest label around it
and then contracts the graph onto the labels; rounds are cut with checkpoints in the shared folder.

Defined cases: no words (null, empty, blanks) gives fingerprint zero, linked like any other; rows
without an id get a fingerprint but no component and link nothing; repeated rows are all returned;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut_lineage, hex64, shielded

SHINGLE = 3
MAX_BITS = 2
SEED = 42
TILE = 2048            # rows of one tile of a bucket
SALT = 16              # parts of the rows of one fingerprint
BLOCK = 7
BATCH_HASHES = 1 << 16


# ---------------------------------------------------------------- fingerprints

def text_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set when it is set in over half of the hashes; counted in blocks of bounded memory."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BATCH_HASHES):
        part = hashes[at:at + BATCH_HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of ``df`` and ``fingerprint`` (64 bits as a long)."""
    keep = [c for c in df.columns if c not in (text_col, "fingerprint")]
    schema = df.select(*keep, F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [majority(text_hashes(t.as_py(), shingle)) for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out, pa.int64())], names=[*keep, "fingerprint"])

    return df.select(*keep, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- anchors

def block_code() -> np.ndarray:
    """Nearest Hamming code word of each 7-bit value: the syndrome names the bit to flip."""
    nearest = []
    for v in range(1 << BLOCK):
        syndrome = 0
        for i in range(BLOCK):
            if v >> i & 1:
                syndrome ^= i + 1
        nearest.append(v ^ (1 << (syndrome - 1)) if syndrome else v)
    return np.array(nearest, np.uint64)


NEAREST = block_code()
SHIFTS = range(0, 63, BLOCK)


def home(points: np.ndarray) -> np.ndarray:
    """The nearest anchor of every point."""
    out = points & np.uint64(1 << 63)
    for s in SHIFTS:
        out |= NEAREST[(points >> np.uint64(s)) & np.uint64(127)] << np.uint64(s)
    return out


def anchors_of(points: np.ndarray, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) for the homes of all points within ``flips`` bits, without repeats."""
    masks, frontier = {0}, {0}
    for _ in range(flips):
        frontier = {m | 1 << i for m in frontier for i in range(64)} - masks
        masks |= frontier
    masks = np.array(sorted(masks), np.uint64)
    all_homes = home((points[:, None] ^ masks[None, :]).ravel()).reshape(len(points), -1)
    all_homes.sort(axis=1)
    new = np.ones(all_homes.shape, bool)
    new[:, 1:] = all_homes[:, 1:] != all_homes[:, :-1]
    at, _ = np.nonzero(new)
    return at, all_homes[new]


def replicate(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, fp) of every distinct fingerprint and every anchor it must visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 1024):
                part = fps[at:at + 1024]
                i, a = anchors_of(part, (max_bits + 1) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(part[i].view(np.int64))], names=["anchor", "fp"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long")


# ---------------------------------------------------------------- links

def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of every edge: hooking to the smaller label, then pointer jumping."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def forest(group: np.ndarray, fps: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that connect what is within ``max_bits`` in each run of equal ``group``. Sides 0 and 1 are two
    tiles of a large bucket, compared with each other only; side -1 compares with all."""
    labels = np.arange(len(fps))
    left, right = [], []
    lag, at = 1, np.arange(len(fps))
    while True:
        at = at[at + lag < len(fps)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits]
        near = near[(side[near] < 0) | (side[near] != side[near + lag])]
        near = near[labels[near] != labels[near + lag]]
        if len(near):
            left.append(near)
            right.append(near + lag)
            labels = join_labels(labels, near, near + lag)
        lag += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, max_bits: int, tile: int = TILE) -> DataFrame:
    """(a, b) of fingerprints at most ``max_bits`` apart: enough links to join all that are connected."""
    placed = replicate(distinct, max_bits)
    large = (placed.groupBy("anchor").count().where(F.col("count") > tile)
             .select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    dealt = (
        placed.join(large, "anchor", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(others)))
        .select("anchor", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"),
                F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte").alias("side"), "fp"))
    shuffled = dealt.repartition("anchor", "t1", "t2").sortWithinPartitions("anchor", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            done, held = whole_groups(held)
            if done is not None:
                yield compare(done)
        if held is not None and held.num_rows:
            yield compare(held)

    def keys(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "t1", "t2")]
        new = np.ones(t.num_rows, bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        return np.cumsum(new)

    def whole_groups(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
        group = keys(t)
        last = int(np.searchsorted(group, group[-1])) if len(group) else 0
        return (t.slice(0, last), t.slice(last)) if last else (None, t)

    def compare(t: pa.Table) -> pa.RecordBatch:
        fps = t.column("fp").to_numpy().astype(np.int64)
        i, j = forest(keys(t), fps.view(np.uint64), t.column("side").to_numpy(), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[i], fps[j])), pa.array(np.maximum(fps[i], fps[j]))], names=["a", "b"])

    return shuffled.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges; the root is one node of its component. Each round hooks every node to
    its smallest neighbour, follows the hooks, and contracts the edges onto what is left, until none is."""
    edges = cut_lineage(edges.where("a <> b"))
    answer = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least"))
        hook = cut_lineage(low.select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        hook = follow(hook)
        if answer is None:
            answer = hook
        else:
            moved = hook.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            new = hook.join(answer.select("node"), "node", "left_anti")
            answer = cut_lineage(
                answer.join(moved, "root", "left")
                .select("node", F.coalesce("__up", "root").alias("root")).union(new))
        a, b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        edges = cut_lineage(
            edges.join(a, "a").join(b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return answer if answer is not None else edges.toDF("node", "root")


def follow(hook: DataFrame) -> DataFrame:
    """Pointer doubling: every node points to the end of its chain (chains strictly decrease, so they end)."""
    while True:
        up = hook.toDF("root", "__up")
        twice = cut_lineage(hook.join(up, "root", "left").select(
            "node", F.coalesce("__up", "root").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")))
        hook = twice.select("node", "root")
        if twice.where("__moved").isEmpty():
            return hook


# ---------------------------------------------------------------- operator

def components_of(marked: DataFrame, max_bits: int, first) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint that some row with an id has: ``least`` is the aggregate ``first`` of its rows."""
    distinct = cut_lineage(marked.where("id is not null").groupBy("fp").agg(first.alias("least")))
    joined = components(links(distinct, max_bits))
    return distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the smallest id reachable over links of ``max_bits`` or fewer bits.
    Copies are dealt over SALT copies of their fingerprint's component, so no task holds all copies of a text."""
    marked = fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle)
    marked = cut_lineage(marked.select("id", F.col("fingerprint").alias("fp")))
    rooted = components_of(marked, max_bits, F.min("id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = marked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    return (dealt.join(cut_lineage(named), ["fp", "salt"], "left")
            .select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"),
                    F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")))


def op5(documents: DataFrame) -> DataFrame:
    """The contract's rows: 3-word shingles, 2 bits."""
    return near_duplicates(documents.select("doc_id", "text"))


def first_of_each(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``documents`` with one document of each component: that of the smallest id (of equal ids, of the smallest
    hash of the text), once. A repeated id does not tie its texts: each belongs to the component of its own fingerprint.
    Rows without an id stay, once for each distinct row; all columns stay as they are."""
    def run(d: DataFrame) -> DataFrame:
        named = d.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
        marked = cut_lineage(fingerprints(named, "text", shingle).select("id", "hash", F.col("fingerprint").alias("fp")))
        rooted = components_of(marked, max_bits, F.min(F.struct("id", "hash")))
        stay = rooted.groupBy("root").agg(F.min("least").alias("w")).select(F.col("w.id").alias("doc_id"), F.col("w.hash").alias("__hash"))
        every = d.withColumn("__row", F.xxhash64(*d.columns)).withColumn("__hash", F.xxhash64("text"))
        kept = every.where("doc_id is not null").join(cut_lineage(stay), ["doc_id", "__hash"], "left_semi").select(*every.columns)
        kept = kept.unionByName(every.where("doc_id is null"))
        # what is left of equal ids and texts: the row of the smallest hash
        once = Window.partitionBy("doc_id", "__hash", F.when(F.col("doc_id").isNull(), F.col("__row"))).orderBy("__row")
        return kept.withColumn("__place", F.row_number().over(once)).where("__place = 1")

    return shielded(documents, ["doc_id", "text"], run)
