"""Product codes of vectors: Lloyd's rounds over partition-local cover trees.

Vectors become integers (floor of SCALE times a component) and are cut into equal consecutive parts; each part
position has a codebook. Every task builds, over blocks of up to BLOCK of its own vectors, a cover tree for each
part: nodes cover their points within a radius, children halve the scale and lie apart, and the points of a node are
neighbours in the tree's order, so running sums over that order give the sum of any subtree. A round sends the
codebooks (a few numbers an entry) to the trees: a node whose nearest entry is nearer than any other by more than
twice its radius gives its whole subtree to that entry by the triangle inequality; only the rest descend, down to
exact comparisons of points. A task returns a count and a sum for each entry. No vector is shuffled, and the trees
are stored once in the shared folder and read by each round.

All numbers are exact integers: products stay below 2**53 in floating point, or are taken as 64-bit integers; bounds
carry a margin, so rounding only sends a node down.

Defined cases: a vector that is null or empty, or holds a null or a non-finite component, is dropped; so is one whose length
differs from that of the kept vector with the smallest id. Components beyond what squared distances of that length
can hold in 64 bits are cut to that bound. A length that the parts do not divide makes the first parts longer by one.
The first codebooks come from the smallest ids (nulls last, equal ids by their vector); fewer kept vectors make fewer
entries, none make an empty result. Equal rows are kept as often as they come. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 2048
LEAF = 8
SALT = 32
MARGIN = 1e-9
TREE = "ids array<{id}>, labels array<{label}>, points binary, trees array<struct<place:binary,center:binary,first:binary,last:binary,parent:binary,depth:binary,radius:binary>>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b`` (integers)."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * top * top < 1 << 53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


class CoverTree:
    """A tree over the rows of ``points``: ``place`` lists them so that each node's are ``place[first:last]``; nodes lie
    in order of their depth."""

    FIELDS = {"place": np.int32, "center": np.int32, "first": np.int32, "last": np.int32, "parent": np.int32, "depth": np.int32, "radius": np.float64}

    def __init__(self, points: np.ndarray, fields: dict[str, np.ndarray]):
        self.points = points
        self.__dict__ |= fields
        self.running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points[self.place], axis=0, out=self.running[1:])

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        far = np.sqrt(squared(points, points).astype(np.float64))
        place = np.arange(len(points), dtype=np.int32)
        nodes: list[tuple] = []
        waiting = deque([(0, 0, len(points), -1, 0)])
        while waiting:
            center, first, last, parent, depth = waiting.popleft()
            own = place[first:last]
            reach = far[center, own]
            radius = float(reach.max())
            nodes.append((center, first, last, parent, depth, radius))
            if last - first <= leaf or radius == 0:
                continue
            within = 2.0 ** (np.ceil(np.log2(radius)) - 1)  # the next scale: at least half the radius, less than all of it
            groups, rest, head = [], own, center
            while len(rest):
                near = reach <= within
                groups.append((head, rest[near]))
                rest = rest[~near]
                if len(rest):
                    head = rest[0]
                    reach = far[head, rest]
            at = first
            for head, group in groups:
                place[at:at + len(group)] = group
                waiting.append((int(head), at, at + len(group), len(nodes) - 1, depth + 1))
                at += len(group)
        cols = list(zip(*nodes))
        names = [n for n in cls.FIELDS if n != "place"]
        return cls(points, {"place": place} | {n: np.array(c, cls.FIELDS[n]) for n, c in zip(names, cols)})

    def packed(self) -> dict[str, bytes]:
        return {n: getattr(self, n).tobytes() for n in self.FIELDS}

    @classmethod
    def unpacked(cls, points: np.ndarray, row: dict[str, bytes]) -> CoverTree:
        return cls(points, {n: np.frombuffer(row[n], t) for n, t in cls.FIELDS.items()})

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of every point (ties to the lower), the count and sum of each entry's points, and how many
        points took an exact comparison of their own."""
        code = np.empty(len(self.points), np.int32)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        down = np.zeros(len(self.center), bool)
        exact = []
        starts = np.flatnonzero(np.diff(self.depth, prepend=-1)).tolist()
        for a, z in zip(starts, [*starts[1:], len(self.depth)]):
            here = np.arange(a, z) if a == 0 else a + np.flatnonzero(down[self.parent[a:z]])
            if not len(here):
                break
            d = squared(self.points[self.center[here]], book)
            near = d.argmin(1)
            row = np.arange(len(here))
            best = np.sqrt(d[row, near].astype(np.float64))
            if len(book) > 1:
                d[row, near] = d.max() + 1
                second = np.sqrt(d.min(1).astype(np.float64))
            else:
                second = np.full(len(here), np.inf)
            radius = self.radius[here]
            whole = (radius == 0) | (second - best > 2 * radius + MARGIN * (1 + best + radius))
            sure, first, last = near[whole], self.first[here[whole]], self.last[here[whole]]
            np.add.at(count, sure, last - first)
            np.add.at(total, sure, self.running[last] - self.running[first])
            code[self.place[_spans(first, last)]] = np.repeat(sure, last - first)
            rest = here[~whole]
            small = self.last[rest] - self.first[rest] <= LEAF
            exact.append(self.place[_spans(self.first[rest[small]], self.last[rest[small]])])
            down[rest[~small]] = True
        own = np.concatenate(exact)
        if len(own):
            near = squared(self.points[own], book).argmin(1)
            code[own] = near
            count += np.bincount(near, minlength=len(book))
            np.add.at(total, near, self.points[own])
        return code, count, total, len(own)


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..last."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()
    return list(zip([0, *ends], ends))


def _bound(dim: int) -> int:
    """Components up to this keep squared distances, summed over a vector, within 62 bits."""
    return int((2.0 ** 62 / max(dim, 1)) ** 0.5 / 2)


def whole_numbers(vectors: list, dim: int, scale: int) -> np.ndarray:
    x = np.floor(np.array(vectors, np.float64).reshape(len(vectors), dim) * scale)
    return np.clip(x, -_bound(dim), _bound(dim)).astype(np.int64)


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec): rows whose vector is whole and finite."""
    usable = (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))


def _forest(kept: DataFrame, dim: int, parts: int, scale: int, block: int) -> DataFrame:
    """One row for each block of a task's vectors: their ids, labels, points, and a packed cover tree for each part."""
    kind = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}

    def block_of(rows: pa.Table) -> pa.RecordBatch:
        points = whole_numbers(rows.column("vec").to_pylist(), dim, scale)
        trees = [CoverTree.build(np.ascontiguousarray(points[:, a:z])).packed() for a, z in _cuts(dim, parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks()) for c in ("id", "label")]
        binary = pa.list_(pa.struct([(n, pa.binary()) for n in CoverTree.FIELDS]))
        return pa.RecordBatch.from_arrays([*lists, pa.array([points.tobytes()], pa.binary()), pa.array([trees], binary)],
                                          names=["ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == block:
                    yield block_of(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block_of(pa.Table.from_batches(held))

    same = kept.where(F.size("vec") == dim)
    return same.mapInArrow(run, TREE.format(**kind))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, parts: int):
    """(ids, labels, points, a cover tree for each part) of every stored block."""
    for b in batches:
        for i in range(b.num_rows):
            points = np.frombuffer(b.column("points")[i].as_py(), np.int64).reshape(-1, dim)
            trees = [CoverTree.unpacked(np.ascontiguousarray(points[:, a:z]), row) for (a, z), row in zip(_cuts(dim, parts), b.column("trees")[i].as_py())]
            yield b.column("ids")[i].values, b.column("labels")[i].values, points, trees


def _round(forest: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round; what comes back is one row for each entry."""
    shared = forest.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        count = [np.zeros(len(b), np.int64) for b in own]
        total = [np.zeros(b.shape, np.int64) for b in own]
        for _, _, _, trees in _blocks(batches, dim, len(own)):
            for p, tree in enumerate(trees):
                _, n, s, _ = tree.assign(own[p])
                count[p] += n
                total[p] += s
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(len(own)) for e in np.flatnonzero(count[p]).tolist()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                         names=["part", "entry", "n", "total"])

    longest = max(b.shape[1] for b in books)
    sums = forest.mapInArrow(run, "part int, entry int, n long, total array<long>")
    rows = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(longest)]).collect()
    new = [b.copy() for b in books]
    for r in rows:
        new[r.part][r.entry] = [r[f"t{i}"] // r.n for i in range(new[r.part].shape[1])]
    shared.unpersist()
    return new


def _coded(forest: DataFrame, books: list[np.ndarray], dim: int, kept: DataFrame) -> DataFrame:
    """(id, label, code, error) of every vector."""
    shared = forest.sparkSession.sparkContext.broadcast(books)
    kind = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for ids, labels, points, trees in _blocks(batches, dim, len(own)):
            codes = np.empty((len(points), len(own)), np.int32)
            error = np.zeros(len(points), np.int64)
            for p, tree in enumerate(trees):
                codes[:, p] = tree.assign(own[p])[0]
                error += ((tree.points - own[p][codes[:, p]]) ** 2).sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * len(own), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error)], names=["id", "label", "code", "error"])

    return forest.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code array<int>, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every kept vector, and the final codebooks (integers, one array for each part)."""
    kept = kept_vectors(df, id_col, vec_col, label_col)
    # the smallest ids start the codebooks: a bounded list
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).select(F.size("vec")).collect()
    dim = first[0][0] if first else 0
    if not dim:
        books = [np.zeros((0, 0), np.int64) for _ in range(parts)]
        return kept.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    seeds = kept.where(F.size("vec") == dim).orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    start = whole_numbers([r.vec for r in seeds], dim, scale)
    books = [start[:, a:z].copy() for a, z in _cuts(dim, parts)]
    forest = cut_lineage(_forest(kept, dim, parts, scale, block))
    for _ in range(rounds):
        books = _round(forest, books, dim)
    return cut_lineage(_coded(forest, books, dim, kept)), books


def with_label_error(coded: DataFrame, salt: int = SALT) -> DataFrame:
    """``label_error``: the error summed over equal labels (nulls together). Sums are combined before the exchange; a
    label's rows are dealt over ``salt`` copies of its sum."""
    totals = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    totals = totals.select("_of", "label_error", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_copy"))
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(salt)).cast("int"))
    return dealt.join(totals, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy"))).drop("_of", "_copy", "_salt")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11(embeddings: DataFrame) -> DataFrame:
    """The contract's row of every kept vector; codes as two hex digits a part."""
    coded, books = compress(embeddings)
    code = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return with_label_error(coded).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
                                          F.lit(books_digest(books)).alias("codebooks_sha256"))
