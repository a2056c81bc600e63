"""Connected components of a table of edges, by alternating large and small stars.

Used by the near-duplicate operators. Every step is a grouped minimum and a join, and every
round is written to the shared folder; no link or component goes to the driver. A round is some ten
stages, each of as many tasks as there are partitions, however few edges there are: the driver keeps and reports
all of them. So FEW edges at most are joined in one task instead, to the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.llm.common import redealt, release, staged

#: So many edges at most are joined in one task, in some 30 MB.
FEW = 1 << 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(redealt(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the smallest of these. Edges point to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(redealt(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, component) of all edges (u, v)."""
    root: dict = {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kind = pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(k) for k in root], kind)], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in edges(a, b); a component is named by its smallest id.

    Edges of equal or null ends add nothing; repeated edges count once. The round that changes no
    edge is the last, however many there are before.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign, before = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), None
    while True:
        mark = now.agg(F.count("*"), sign).collect()[0]
        if before is None and 0 < mark[0] <= FEW:
            kind = now.schema["u"].dataType.simpleString()
            made = staged(now.coalesce(1).mapInArrow(_joined, f"id {kind}, component {kind}"), "components")
            release(now)
            return made
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = staged(_small_star(_large_star(now)), "stars")
        release(last)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
