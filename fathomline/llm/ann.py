"""Approximate nearest neighbours: learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts that keep
neighbours together; a small classifier then learns to tell the part of any
vector from the vector alone.  It routes every vector of the index to its most
probable part and every query to several, where candidates are reranked by
their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest rows (largest cosine, x of unit length) of every row."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """A part for every row, of at most slack * n / parts rows, that cuts few edges.

    Starts from balanced clusters of the vectors and moves rows to the part of
    most of their neighbours while there is room, best gains first.
    """
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = (x @ centre.T).argmax(axis=1)
        for p in range(parts):
            own = x[near == p]
            centre[p] = own.mean(axis=0) if len(own) else x[rng.integers(n)]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    score = x @ centre.T
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(axis=1)):
        for p in np.argsort(-score[i]):
            if size[p] < room:
                part[i], size[p] = p, size[p] + 1
                break
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts)
        gain = votes - votes[np.arange(n), part][:, None]
        goal = gain.argmax(axis=1)
        best = gain[np.arange(n), goal]
        movers = np.flatnonzero(best > 0)
        if not len(movers):
            break
        moved = 0
        for i in movers[np.argsort(-best[movers], kind="stable")][: max(1, n // 4)]:
            if size[goal[i]] < room:
                size[part[i]] -= 1
                size[goal[i]] += 1
                part[i] = goal[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer from a unit vector to the parts' probabilities."""

    def __init__(self, x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 96, epochs: int = 30, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        # a row's goal is where its neighbours are, and itself
        goal = np.bincount((np.repeat(np.arange(len(x)), graph.shape[1]) * parts + part[graph].ravel()), minlength=len(x) * parts).reshape(len(x), parts).astype(np.float32)
        goal[np.arange(len(x)), part] += 1
        goal /= goal.sum(axis=1, keepdims=True)
        shapes = ((d, hidden), (hidden,), (hidden, parts), (parts,))
        self.w = [(rng.standard_normal(s) * (np.sqrt(2 / s[0]) if len(s) > 1 else 0)).astype(np.float32) for s in shapes]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        x = x.astype(np.float32)
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                a = x[rows]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                e = (self._softmax(h @ self.w[2] + self.w[3]) - goal[rows]) / len(rows)
                back = (e @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x.astype(np.float32) @ self.w[0] + self.w[1], 0)
        return self._softmax(h @ self.w[2] + self.w[3])


def _clean(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v of doubles; rows that no cosine is defined for go."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, safe against very large and very small numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, k: int = 5, part_rows: int = 64, most_parts: int = 1024,
           part_sample: int = 48, least_sample: int = 12_288, mass: float = 0.97, least_probes: int = 3, block_rows: int = 4_096, seed: int = 3) -> DataFrame:
    """The k nearest vectors found for every row whose id is divisible by query_every.

    Nearness is the largest cosine in double precision on the original
    vectors; ties go to the smaller id.  Returns query_id, rank (from 1),
    vec_id, score.  n vectors have sqrt(n) / 2 parts, of part_rows vectors at
    least and most_parts in number.  The partition and the router are fitted on
    vectors chosen by hash, part_sample a part and least_sample at least (so
    49,152 at most); every vector is indexed.  A query visits its most probable
    parts until they hold ``mass`` of the probability, and least_probes at
    least.  A part is searched in blocks of about block_rows vectors and as
    many queries, so a part of any size spreads.

    Vectors that are null, empty, all zero, or that hold null or non-finite
    components take no part; nor do those of another length than most of the
    sample, or without id.  Rows that repeat an id are each a candidate of the
    others' queries, and one query (the row that comes first in its task).
    Fewer than two parts' rows are one part.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _clean(vectors, id_col, vector_col).filter("vec_id IS NOT NULL")
    n = rows.count()
    kinds = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], kinds)
    parts = max(1, min(most_parts, n // part_rows, int(n**0.5 / 2)))
    sample = max(part_sample * parts, least_sample)
    share = min(1.0, sample / n)
    chosen = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    if not chosen.num_rows:
        chosen = rows.limit(sample).toArrow()
    sizes = np.array([len(x) for x in chosen["v"].to_pylist()])
    dim = int(np.bincount(sizes).argmax())
    rows = rows.filter(F.size("v") == dim)
    # ties of the sample's order would change the fit, so it is put in order
    order = np.lexsort((np.arange(len(sizes)), chosen["vec_id"].to_numpy()))
    x = _unit(np.array([chosen["v"][int(i)].as_py() for i in order if sizes[i] == dim]))
    parts = max(1, min(parts, len(x) // (part_rows // 2)))
    router = None
    if parts > 1:
        graph = neighbour_graph(x, 10)
        router = Router(x, balanced_parts(x, graph, parts), graph, parts)
    shared = spark.sparkContext.broadcast(router)
    blocks = max(1, -(-n // (parts * block_rows)))
    query_blocks = max(1, -(-4 * n // (query_every * parts * block_rows)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1))
            at, turn_of = b.column(2).to_numpy(), b.column(3).to_numpy()
            p = net.probabilities(_unit(v)) if net is not None else np.ones((len(v), 1))
            query = ids % query_every == 0
            index = np.arange(len(v))
            home = [(index, p.argmax(axis=1), at % blocks, np.zeros(len(v), bool))]
            q = index[query]
            rank = np.argsort(-p[q], axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p[q], rank, 1), axis=1) - np.take_along_axis(p[q], rank, 1)
            visit = (before < mass) | (np.arange(p.shape[1]) < least_probes)
            who, col = np.nonzero(visit)
            for block in range(blocks):
                home.append((q[who], rank[who, col], np.full(len(who), block), np.ones(len(who), bool)))
            row, part, block, is_query = (np.concatenate(c) for c in zip(*home, strict=True))
            # a block of vectors meets one block of queries at a time
            reps = np.where(is_query, 1, query_blocks)
            side = np.concatenate([[0], np.cumsum(reps)[:-1]])
            again = np.repeat(np.arange(len(row)), reps)
            turn = np.arange(len(again)) - np.repeat(side, reps)
            qb = np.where(is_query[again], turn_of[row[again]] % query_blocks, turn)
            take = pa.array(row[again])
            yield pa.RecordBatch.from_arrays([pa.array(part[again], pa.int32()), pa.array(block[again], pa.int64()), pa.array(qb, pa.int64()), pa.array(is_query[again]), b.column(0).take(take), b.column(1).take(take)],
                                             names=["part", "block", "qb", "is_query", "vec_id", "v"])

    # candidates spread by their place, so that rows of one id do; queries by id, so that such rows meet
    spot, turn = (F.pmod(F.xxhash64(c, F.lit(seed + 1)), F.lit(1 << 40)) for c in (F.monotonically_increasing_id(), F.col("vec_id")))
    routed = rows.select("vec_id", "v", spot.alias("at"), turn.alias("turn")).mapInArrow(route, "part int, block long, qb long, is_query boolean, vec_id long, v array<double>")

    def rerank(group: pa.Table) -> pa.Table:
        flag = group["is_query"].combine_chunks().to_numpy(zero_copy_only=False)
        v = _unit(_matrix(group["v"].combine_chunks()))
        ids_np = group["vec_id"].combine_chunks().to_numpy()
        base, base_ids = v[~flag], ids_np[~flag]
        out = ([], [], [])
        if len(base):
            sort = np.argsort(base_ids, kind="stable")
            base, base_ids = base[sort], base_ids[sort]
            seen: set[int] = set()
            queries = [i for i in np.flatnonzero(flag) if not (int(ids_np[i]) in seen or seen.add(int(ids_np[i])))]
            for at in range(0, len(queries), 256):
                some = queries[at : at + 256]
                score = v[some] @ base.T
                score[base_ids[None, :] == ids_np[some][:, None]] = -np.inf
                for j, i in enumerate(some):
                    # everything that may tie with the k-th is ordered exactly
                    edge = np.partition(score[j], -min(k, len(base)))[-min(k, len(base))]
                    near = np.flatnonzero((score[j] >= edge - 1e-12) & np.isfinite(score[j]))
                    exact = (base[near] * v[i]).sum(axis=1)
                    best = np.lexsort((base_ids[near], -exact))[:k]
                    out[0].extend([int(ids_np[i])] * len(best))
                    out[1].extend(base_ids[near[best]].tolist())
                    out[2].extend(exact[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = routed.groupBy("part", "block", "qb").applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, k: int = 5) -> DataFrame:
    """The same answer by comparing every query with every vector; it measures recall."""
    return search(vectors, id_col=id_col, vector_col=vector_col, query_every=query_every, k=k, most_parts=1)
