"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut in segments of about log2(n) bits and every segment is indexed by its value. Round r looks up, for each open
query and segment, the values exactly r bits from the query's; every candidate's full distance is verified. A code is taken
once: in the round of its nearest segment, from the first segment that is as near. After round r
all codes closer than segments * (r + 1) have been met (one segment of such a code differs in at most r bits), so a query
is done once its k-th verified distance is below that. Others go on to radius r + 1.

Equal codes are collapsed before indexing, with their k smallest ids (a bounded list, limited map-side by Spark's ranked
limit), and equal queries are searched once, so a code shared by a third of all rows costs one entry. Candidates are cut
to the k best per query by the same ranked limit; rounds are cut with checkpoints in the shared folder.

Defined cases: rows without id or code are neither found nor queries; ties go to the smaller id; a query finds
itself and its copies; repeated rows are one row; with fewer than k rows all are returned; empty tables work.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.llm.common import cut_lineage, literal

K = 10
QUERY_EVERY = 50


def sign_code(vector: str, bits: int) -> Column:
    """One bit an element, set where it is positive; null for a vector of another length or with nulls."""
    code = F.expr(f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return F.when((F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull()), code)


def segment_bounds(n_codes: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of segments of about log2(n) bits, widths at most one apart."""
    m = min(bits, max(1, round(bits / max(8.0, math.log2(max(2, n_codes))))))
    widths = [bits // m + (i < bits % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def segments(code: str, bounds: list[tuple[int, int]]) -> Column:
    """Array of (segment number, value)."""
    return F.array(*[
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(F.col(code), s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
        for i, (s, w) in enumerate(bounds)])


def flips(width: int, r: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), r)]


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "first")  # a code is as good as its smallest id
    return found.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")


def top_k(rows: DataFrame, queries: DataFrame, *, id_col: str, code_col: str, k: int = K, bits: int = 64) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k rows nearest to every query."""
    own = lambda df: df.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null")
    ids = (own(rows).distinct().withColumn("__rn", F.row_number().over(Window.partitionBy("code").orderBy("id")))
           .where(F.col("__rn") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    codes = cut_lineage(ids)
    bounds = segment_bounds(codes.count(), bits)
    index = cut_lineage(codes.select("code", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.explode(segments("code", bounds)).alias("s"))
                        .select(F.col("s.segment").alias("segment"), F.col("s.value").alias("value"), "code", "n", "first"))
    asked = cut_lineage(own(queries).distinct())
    open_ = cut_lineage(asked.select(F.col("code").alias("q")).distinct())
    done = found = None
    widest = max(w for _, w in bounds)
    for r in range(widest + 1):
        masks = F.element_at(F.create_map(*[
            x for i, (_, w) in enumerate(bounds) for x in (F.lit(i), literal(flips(w, r), "array<bigint>"))]), F.col("s.segment"))
        probes = (open_.select("q", F.explode(segments("q", bounds)).alias("s"))
                  .select("q", F.col("s.segment").alias("segment"), F.col("s.value").alias("v"), F.explode(masks).alias("mask"))
                  .select("q", "segment", F.col("v").bitwiseXOR(F.col("mask")).alias("value")))
        apart = [F.bit_count(F.shiftrightunsigned(F.col("differ"), s).bitwiseAND(F.lit((1 << w) - 1))) for s, w in bounds]
        met = (probes.join(index, ["segment", "value"]).withColumn("differ", F.col("q").bitwiseXOR(F.col("code")))
               .withColumns({"distance": F.bit_count("differ"), "meets": F.array(*apart)})
               .where((F.array_min("meets") == r) & (F.array_position("meets", r) == F.col("segment") + 1))
               .select("q", "code", "n", "first", "distance"))
        found = cut_lineage(best(met if found is None else found.union(met), k))
        covered = len(bounds) * (r + 1) - 1
        settled = (found.groupBy("q").agg(F.sum(F.when(F.col("distance") <= covered, F.col("n"))).alias("near"))
                   .where((F.col("near") >= k) | F.lit(r == widest)).select("q"))
        ready = found.join(settled, "q")
        done = cut_lineage(ready if done is None else done.union(ready))
        found = cut_lineage(found.join(settled, "q", "left_anti"))
        open_ = cut_lineage(open_.join(settled, "q", "left_anti"))
        if open_.isEmpty():
            break
    listed = done.select("q", "code", "distance").join(codes, "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))
    ranked = cut_lineage(listed.withColumn("rank", rank).where(F.col("rank") <= k))
    return (asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ranked, "q")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", F.col("distance").cast("int").alias("distance")))


def op7(embeddings: DataFrame) -> DataFrame:
    """Sign codes of all vectors; every row whose id is divisible by 50 asks for its 10 nearest."""
    rows = embeddings.select("vec_id", sign_code("embedding", 64).alias("code"))
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0), id_col="vec_id", code_col="code")
