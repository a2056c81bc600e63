"""Operator 10: approximate nearest neighbours by learned partitions.

A bounded sample gives a graph of nearest neighbours, which is cut into balanced parts; a small
network learns to tell a vector's parts from the vector. It then deals every vector to its most
probable part, and routes every query to several; how many is measured on sample vectors held
back from the network. The number of parts grows with the vectors, and the sample with the parts.
A part is one block, or more if it has more vectors; each vector goes to one block, and the queries
that visit a part stream past its blocks. Candidates are found by a matrix product, and the best
are scored again in double precision in the order of the components. What a query finds in a block is one row.

Vectors of each dimension are searched among their own. The most frequent MAX_NETWORKS dimensions
have networks; any others are searched whole, in blocks.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part;
nor do rows without id. Repeated ids count once (the vector of the smallest dimension, and the smallest of these).
Ties go to the smaller id. Fewer candidates than asked for are all
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import list_array, rows_of, slices, staged

#: Vectors that parts and network are fitted to: so many a part, within these bounds, and bytes at most.
FIT_ROWS_A_PART, FIT_ROWS, MAX_FIT_ROWS, FIT_BYTES = 64, 4096, 65_536, 128 << 20
HELD_BACK = 512
GRAPH_NEIGHBOURS = 10
#: Vectors a part should have; parts are between these numbers.
PART_ROWS = 1024
MIN_PARTS, MAX_PARTS = 8, 4096
#: Dimensions that have a network of their own.
MAX_NETWORKS = 8
#: Recall of the true neighbours that routing must reach on the vectors held back.
ROUTE_RECALL = 0.94
#: Vectors of a block, about, which a task holds while queries stream past.
BLOCK_ROWS = 16_384


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector by inner product, nearest first."""
    out = []
    for at in range(0, len(vectors), 512):
        scores = vectors[at : at + 512] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(best, order, 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 12) -> np.ndarray:
    """A part for each vertex, few edges between parts, no part above slack times its share.

    Vertices are dealt in breadth-first order to the part with most of their neighbours,
    weighed by the room left; sweeps then move vertices where they have more neighbours.
    """
    n = len(graph)
    both: list[list[int]] = [[] for _ in range(n)]
    for v, near in enumerate(graph.tolist()):
        for u in near:
            both[v].append(u)
            both[u].append(v)
    room = int(np.ceil(slack * n / parts))
    part, sizes = np.full(n, -1), np.zeros(parts)
    order, seen = [], np.zeros(n, bool)
    for root in range(n):
        if not seen[root]:
            seen[root] = True
            queue = [root]
            for v in queue:
                for u in both[v]:
                    if not seen[u]:
                        seen[u] = True
                        queue.append(u)
            order += queue
    for sweep in range(sweeps + 1):
        moved = 0
        for v in order:
            near = part[both[v]]
            pull = np.bincount(near[near >= 0], minlength=parts).astype(float)
            own = part[v]
            if own >= 0:
                sizes[own] -= 1
            score = (pull + 1e-3) * (1 - sizes / room)
            score[sizes >= room] = -1
            if own >= 0 and sizes[own] < room:
                score[own] += 1e-9
            new = int(np.argmax(score))
            moved += new != own
            part[v] = new
            sizes[new] += 1
        if not moved:
            break
    return part


@dataclass
class Network:
    """One hidden layer; gives the log probability of each part, up to a constant."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, seed: int = 7) -> Network:
    """A network fitted to target probabilities by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    x, target = x.astype(np.float32), target.astype(np.float32)
    scale = np.float32(np.sqrt(np.mean(np.sum(x * x, axis=1))) or 1)
    sizes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    weights = [rng.normal(0, np.sqrt(2 / x.shape[1]) / scale * np.sqrt(x.shape[1]) / 4, sizes[0]), np.zeros(sizes[1]), rng.normal(0, np.sqrt(1 / hidden), sizes[2]), np.zeros(sizes[3])]
    weights = [w.astype(np.float32) for w in weights]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            w1, b1, w2, b2 = weights
            h = np.maximum(x[rows] @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - target[rows]) / len(rows)
            dh = dz @ w2.T * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(*weights)


def fit(sample: np.ndarray, parts: int, k: int) -> tuple[Network, int]:
    """The network, and the number of parts a query must visit."""
    held = min(HELD_BACK, len(sample) // 8)
    own, back = sample[held:], sample[:held]
    graph = neighbour_graph(own, min(GRAPH_NEIGHBOURS, len(own) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.arange(len(own)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(own)), graph.shape[1]), part[graph].ravel()), 1.0)
    network = train(own, target / target.sum(1, keepdims=True))
    if not held:
        return network, parts
    near = np.argsort(-(back @ own.T), axis=1, kind="stable")[:, :k]
    dealt = np.argmax(network.logits(own), axis=1)
    place = np.argsort(np.argsort(-network.logits(back), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, dealt[near], 1)
    recall = [(needed < m).mean() for m in range(1, parts + 1)]
    return network, next(m for m, r in enumerate(recall, 1) if r >= ROUTE_RECALL or m == parts)


def valid(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def exact_scores(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    return np.cumsum(candidates.astype(np.float64) * query.astype(np.float64), axis=1)[:, -1]


def block_best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best of a block for each query, its own id left out.

    The matrix product may err by as much as the lengths of both vectors and their dimension allow;
    all candidates within twice that of the k-th are scored exactly.
    """
    out, vectors64 = [], vectors.astype(np.float64)
    longest = float(np.sqrt((vectors64 * vectors64).sum(1).max())) if len(vectors64) else 0.0
    step = max(1, (4 << 20) // max(1, len(ids)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step].astype(np.float64)
        slack = 4 * vectors64.shape[1] * 2.0**-52 * longest * np.sqrt((part * part).sum(1))
        scores = part @ vectors64.T
        scores[query_ids[at : at + step, None] == ids[None, :]] = -np.inf
        keep = min(k, scores.shape[1])
        edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        for row, least in enumerate(edge):
            near = scores[row] >= least - slack[row] if np.isfinite(least) else np.isfinite(scores[row])
            found = np.flatnonzero(near)
            exact = exact_scores(queries[at + row], vectors[found])
            best = np.lexsort((ids[found], -exact))[:keep]
            out.append((int(query_ids[at + row]), ids[found][best], exact[best]))
    return out


@dataclass
class Routes:
    """How the vectors of one dimension are dealt and routed."""

    network: Network
    parts: int
    visits: int


def fitted(rows: DataFrame, dim: int, n: int, k: int) -> Routes | None:
    """Parts of the n vectors of a dimension, learned from a sample; None where one part will do."""
    parts = min(MAX_PARTS, max(MIN_PARTS, -(-n // PART_ROWS)))
    wanted = min(max(FIT_ROWS, FIT_ROWS_A_PART * parts), MAX_FIT_ROWS, FIT_BYTES // (4 * dim))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.where((F.size("vector") == dim) & (draw < min(1.0, wanted / n))).select("id", "vector").collect()
    sample = np.asarray([r["vector"] for r in sorted(drawn, key=lambda r: r["id"])], np.float32).reshape(-1, dim)
    parts = min(parts, len(sample) // 16)
    if parts < 2:
        return None
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    network, visits = fit(sample, parts, k)
    return Routes(network, parts, visits)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for the rows where is_query holds, the k nearest others.

    is_query speaks of the columns id and vector. Nearness is the largest inner product.
    """
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    number = np.dtype(np.float32 if kind == "array<float>" else np.float64)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    frequent = sizes.orderBy(F.col("n").desc(), "dim").limit(MAX_NETWORKS).collect()
    rows = rows.groupBy("id").agg(F.min(F.struct(F.size("vector").alias("dim"), "vector")).alias("v")).select("id", "v.vector")
    routes = {r["dim"]: made for r in frequent if (made := fitted(rows, r["dim"], r["n"], k)) is not None}

    def deal(batches):
        for part in slices(batches, 4096):
            vectors, asked = part.column(1), part.column(2).to_pylist()
            offsets = vectors.offsets.to_numpy()
            flat, dims = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
            own, orders = np.zeros(len(dims), np.int32), [np.zeros(1, np.int32)] * len(dims)
            for dim in set(dims.tolist()) & set(routes):
                at = np.flatnonzero(dims == dim)
                logits = routes[dim].network.logits(flat[offsets[at][:, None] + np.arange(dim)])
                order = np.argsort(-logits, axis=1, kind="stable").astype(np.int32)
                own[at] = order[:, 0]
                for i, o in zip(at.tolist(), order, strict=True):
                    orders[i] = o
            routed = [o if q else o[:0] for o, q in zip(orders, asked, strict=True)]
            raw = [flat[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(asked, pa.bool_()), pa.array(own, pa.int32()), list_array(np.concatenate(routed), np.asarray(list(map(len, routed))), pa.int32())], ["id", "vector", "dim", "asked", "part", "routes"])

    schema = "id bigint, vector binary, dim int, asked boolean, part int, routes array<int>"
    dealt = staged(rows.select("id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInArrow(deal, schema), "ann")
    held = staged(dealt.groupBy("dim", "part").agg(F.count("*").alias("n")), "parts")
    visits = F.size("routes")
    for dim, own in routes.items():
        least = np.cumsum(sorted(r["n"] for r in held.where(F.col("dim") == dim).collect()))
        enough = int(np.searchsorted(least, k + 1)) + 1 + own.parts - len(least)  # parts without vectors may be the first
        visits = F.when(F.col("dim") == dim, F.lit(min(own.parts, max(own.visits, enough)))).otherwise(visits)
    blocks = held.select("dim", "part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = dealt.where("asked").select("id", "vector", "dim", F.explode(F.slice("routes", 1, F.greatest(visits, F.lit(1)))).alias("part"))
    passing = asked.join(blocks, ["dim", "part"]).select("dim", "part", every.alias("block"), F.lit(True).alias("asks"), "id", "vector")
    standing = dealt.select("id", "vector", "dim", "part").join(blocks, ["dim", "part"]).select("dim", "part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vector")
    ordered = standing.unionByName(passing).repartition("dim", "part", "block").sortWithinPartitions("dim", "part", "block", "asks", "id")

    def compare(batches):
        key, ids, vectors, block = None, [], [], None
        for part in slices(batches, 1024):
            dims, parts, numbers, asks, own, raw = (c.to_pylist() for c in part.columns)
            found, at = [], 0
            while at < part.num_rows:
                here = dims[at], parts[at], numbers[at]
                if here != key:
                    key, ids, vectors, block = here, [], [], None
                end = at
                while end < part.num_rows and (dims[end], parts[end], numbers[end], asks[end]) == (*here, asks[at]):
                    end += 1
                if not asks[at]:
                    ids += own[at:end]
                    vectors += raw[at:end]
                elif block is not None or ids:
                    if block is None:
                        block, vectors = np.frombuffer(b"".join(vectors), number).reshape(-1, here[0]), []
                        ids = np.asarray(ids, np.int64)
                    queries = np.frombuffer(b"".join(raw[at:end]), number).reshape(-1, here[0])
                    found += block_best(queries, np.asarray(own[at:end], np.int64), block, ids, k)
                at = end
            yield lists(found)

    def lists(found):
        lengths = np.asarray([len(own) for _, own, _ in found], np.int64)
        flat = [np.concatenate([row[k] for row in found]) if found else np.empty(0) for k in (1, 2)]
        columns = [pa.array([q for q, _, _ in found], pa.int64()), list_array(flat[0].astype(np.int64), lengths, pa.int64()), list_array(flat[1], lengths, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "ids", "scores"])

    def merge(batches):
        """The k best of each query's lists, which come one after the other."""
        query, own, scores = None, [], []

        def best():
            if query is None:
                return []
            all_ids, all_scores = np.concatenate(own), np.concatenate(scores)
            order = np.lexsort((all_ids, -all_scores))[:k]
            return [(query, rank, i, s) for rank, (i, s) in enumerate(zip(all_ids[order].tolist(), all_scores[order].tolist(), strict=True), 1)]

        def rows(made):
            columns = list(zip(*made, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for part in slices(batches, 1024):
            made = []
            for q, ids, values in zip(part.column(0).to_pylist(), rows_of(part.column(1)), rows_of(part.column(2)), strict=True):
                if q != query:
                    made += best()
                    query, own, scores = q, [], []
                own.append(ids)
                scores.append(values)
            yield rows(made)
        yield rows(best())

    found = ordered.mapInArrow(compare, "query_id bigint, ids array<bigint>, scores array<double>")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {"op10_learned_ann": query}
