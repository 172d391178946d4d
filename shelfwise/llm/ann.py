"""Approximate nearest neighbours: a robust-pruned directed graph over each shard, searched with a beam.

Vectors are dealt to shards of bounded size by a hash of the vector. Each shard builds its own graph: points are inserted in
batches that double, a greedy search over the graph so far proposes neighbours, and relaxed distance pruning keeps an edge
only where no kept neighbour lies much nearer to its end, which leaves diverse edges. A query searches every shard with a
beam from the shard's central point; the best of all shards are ranked by the exact cosine. The searches of a batch advance
together, so a step is a few numpy operations. Equal vectors are one node that carries the least ids, so a hot vector costs
no more than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.llm.common import stored

SHARD_ROWS = 8_192
QUERY_BLOCK = 4_096
DEGREE, BEAM, RELAXED = 24, 48, 1.2
#: Edges back to a point wait in this many places before they are pruned to DEGREE again.
PLACES = 40
SEARCH_BEAM = 192
#: Nodes that each search expands in a step, and searches that advance together.
WIDE, TOGETHER = 4, 512


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Ids (queries x beam) of the best points found, best first, -1 where fewer were found."""
    n, count = len(points), len(queries)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # the place of missing neighbours
    row = np.arange(count)[:, None]
    ids = np.full((count, beam), n)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0], seen[:, entry] = entry, queries @ points[entry], False, True
    padded = np.vstack([points, np.zeros((1, points.shape[1]), points.dtype)])
    while True:
        active = np.flatnonzero(~done.all(axis=1))
        if not len(active):
            break
        at = np.argsort(np.where(done[active], 1, 0), axis=1, kind="stable")[:, :WIDE]  # best first, as ids are
        sub = active[:, None]
        chosen = np.where(done[sub, at], n, ids[sub, at])
        done[sub, at] = True
        found = np.where((chosen == n)[:, :, None], n, edges[np.minimum(chosen, n - 1)]).reshape(len(active), -1)
        found = np.sort(np.where(found < 0, n, found), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        found[seen[sub, found]] = n
        seen[sub, found] = True
        score = np.einsum("qd,qnd->qn", queries[active], padded[found], optimize=True)
        score[found == n] = -np.inf
        all_ids = np.concatenate([ids[active], found], axis=1)
        all_near = np.concatenate([near[active], score], axis=1)
        all_done = np.concatenate([done[active], found == n], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        here = row[: len(active)]
        ids[active], near[active], done[active] = all_ids[here, best], all_near[here, best], all_done[here, best]
    ids[np.isneginf(near)] = n
    return np.where(ids == n, -1, ids)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, relaxed: float) -> np.ndarray:
    """The kept neighbours (rows x DEGREE, -1 for none) of the points own: nearest candidate first, and none that a kept
    one is nearer to by the relaxation."""
    n = len(points)
    valid = (candidates >= 0) & (candidates != own[:, None])
    ordered = np.sort(np.where(valid, candidates, n), axis=1)
    valid = np.concatenate([ordered[:, :1] < n, (ordered[:, 1:] < n) & (ordered[:, 1:] != ordered[:, :-1])], axis=1)
    vectors = points[np.minimum(ordered, n - 1)]
    away = 2 - 2 * np.einsum("pd,pcd->pc", points[own], vectors, optimize=True)
    away[~valid] = np.inf
    by = np.argsort(away, axis=1, kind="stable")
    here = np.arange(len(own))[:, None]
    ordered, away, vectors, alive = ordered[here, by], away[here, by], vectors[here, by], valid[here, by]
    between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
    kept = np.full((len(own), DEGREE), -1, np.int32)
    count = np.zeros(len(own), np.int64)
    for c in range(ordered.shape[1]):
        take = np.flatnonzero(alive[:, c] & (count < DEGREE))
        if len(take):
            kept[take, count[take]] = ordered[take, c]
            count[take] += 1
            alive[take] &= relaxed * relaxed * between[take, c] > away[take]
    return kept


def _add_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray, kept: np.ndarray, relaxed: float) -> None:
    """Each kept neighbour gets an edge back; one that runs out of places is pruned."""
    start, end = np.repeat(own, DEGREE)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", points[start], points[end]), end))  # nearest first for each end
    start, end = start[order], end[order]
    ends, first, count = np.unique(end, return_index=True, return_counts=True)
    place = np.arange(len(end)) - np.repeat(first, count)
    fits = place < PLACES
    incoming = np.full((len(ends), PLACES), -1, np.int32)
    incoming[np.repeat(np.arange(len(ends)), count)[fits], place[fits]] = start[fits]
    joined = np.sort(np.concatenate([edges[ends], incoming], axis=1), axis=1)[:, ::-1]
    joined[:, 1:][joined[:, 1:] == joined[:, :-1]] = -1
    many = (joined >= 0).sum(axis=1) > PLACES
    few = np.sort(joined[~many], axis=1)[:, ::-1]
    edges[ends[~many]] = few[:, :PLACES]
    for at in range(0, int(many.sum()), TOGETHER):
        over = ends[many][at : at + TOGETHER]
        edges[over] = -1
        edges[over, :DEGREE] = robust_prune(points, over, joined[many][at : at + TOGETHER], relaxed)


def build_graph(points: np.ndarray, relaxed: float = RELAXED, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (points x PLACES, -1 for none) and the entry, the point nearest to the mean. points: unit vectors."""
    n = len(points)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    edges = np.full((n, PLACES), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        own = order[at : at + size]
        kept = robust_prune(points, own, beam_search(points, edges, entry, points[own], BEAM), relaxed)
        edges[own, :DEGREE] = kept
        _add_back(points, edges, own, kept, relaxed)
        at, size = at + size, min(2 * size, TOGETHER)
    return edges, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / big  # keeps squares of very large or small components finite
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (queries * vectors).sum(axis=1) / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) without null ids and vectors that are null, empty, zero or hold a null or non-finite component."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0))
    )


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index over (vec_id, vector): a row (dim, shard, node, ids, vector, edges, entry) for each different vector.
    ids: its keep least ids. Vectors of different lengths never meet."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = stored(
        vectors.withColumn("__rank", rank).where(F.col("__rank") <= keep).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "nodes",
    )
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda ids: ids.str[0]).reset_index(drop=True)
        edges, entry = build_graph(_unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)))
        return rows.assign(node=np.arange(len(rows), dtype=np.int32), edges=list(edges), entry=np.arange(len(rows)) == entry)[
            ["dim", "shard", "node", "ids", "vector", "edges", "entry"]
        ]

    schema = "dim int, shard int, node int, ids array<long>, vector array<double>, edges array<int>, entry boolean"
    return stored(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graph")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query (vec_id, vector) but itself.

    Queries go to every shard of their length in blocks, so a task holds one graph and one block."""
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.size("vector").alias("dim"))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()
    asked = queries.select("*", block).join(shards, "dim")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(graph: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(asks):
            graph = graph.sort_values("node").reset_index(drop=True)
            exact = np.stack(graph["vector"].to_numpy()).astype(np.float64)
            points, edges = _unit(exact), np.stack(graph["edges"].to_numpy())
            entry = int(np.flatnonzero(graph["entry"])[0])
            ids = graph["ids"].to_numpy()
            for at in range(0, len(asks), TOGETHER):
                part = asks.iloc[at : at + TOGETHER]
                wanted = np.stack(part["query"].to_numpy()).astype(np.float64)
                found = beam_search(points, edges, entry, _unit(wanted), max(beam, 2 * k + 2))
                which, place = np.nonzero(found >= 0)
                nodes = found[which, place]
                score = cosine(wanted[which], exact[nodes])
                best = pd.DataFrame({"which": which, "node": nodes, "score": score, "low": [ids[x][0] for x in nodes]})
                best = best.sort_values(["which", "score", "low"], ascending=[True, False, True]).groupby("which").head(k + 1)
                names = part["query_id"].to_numpy()[best["which"]]
                rows = [(q, i, s) for q, x, s in zip(names, best["node"], best["score"]) for i in ids[x] if i != q]
                out.append(pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = (
        graphs.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
        .applyInPandas(run, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by every, the k nearest other rows by cosine.

    embeddings: vec_id, embedding. Vectors null, empty, zero or with a null or non-finite component take no part, nor do null
    ids. Ties go to the smaller id. A row repeated with its id counts once. Fewer than k others: all of them. An empty table
    gives an empty result; other columns are not read.
    """
    vectors = usable(embeddings).dropDuplicates(["vec_id"])
    index = build_index(vectors, k + 1, shard_rows)
    return search(index, vectors.where(F.col("vec_id") % every == 0), k)
