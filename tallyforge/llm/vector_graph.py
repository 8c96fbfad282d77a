"""Approximate nearest neighbours by inner product, in robust-pruned directed graphs.

Equal vectors are one node, which carries the smallest of their ids. Nodes are dealt into shards of bounded size, each with a graph
of its own: nodes join in growing batches, a greedy beam search on the graph so far proposes neighbours, and relaxed distance pruning
keeps a proposal only if no kept neighbour is nearer to it by the factor ``ALPHA`` than the node itself. A beam search answers a query in each shard.

Largest inner product becomes least distance by one more coordinate, which brings all vectors of a shard to one length; queries have
zero there. The index is a written table, one row for each node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import stored

#: neighbours of a node, and nodes that a search keeps while building and while answering a query in a shard of FEWEST nodes
DEGREE = 32
BUILD_BEAM = 96
SEARCH_BEAM = 128
#: how much nearer a kept neighbour must be to a proposal than the node itself to make it needless
ALPHA = 1.1
#: nodes of a shard: fewest, most, and the factor of the square root of all nodes between them
FEWEST, MOST, ROOT = 8_192, 262_144, 32
#: vector components of a shard at most
MOST_VALUES = 1 << 24
#: queries that meet a shard in one task
QUERY_BLOCK = 65_536
#: open nodes that a search visits in one step, queries that take steps together, nodes that join together
VISITS, TOGETHER, JOINING = 4, 256, 1_024

INDEX = "shard int, dim int, pos int, node long, ids array<long>, vector array<double>, links array<int>"
INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]
FOUND = "node long, vec_id long, score double"


# --- one graph ---


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with the coordinate that brings them to one length, that of the longest, which is the unit."""
    vectors = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", vectors, vectors)
    rest = np.sqrt(np.maximum(0, squares.max() - squares))
    return (np.concatenate((vectors, rest[:, None]), 1) / math.sqrt(squares.max())).astype(np.float32)


def asked_points(queries: np.ndarray) -> np.ndarray:
    """Queries at unit length, the added coordinate zero. Their length does not change which vectors are nearest."""
    queries = queries / np.abs(queries).max(1)[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return np.concatenate((queries / length[:, None], np.zeros((len(queries), 1))), 1).astype(np.float32)


def middle_node(points: np.ndarray) -> int:
    """The node nearest to the mean, where searches begin."""
    off = points - points.mean(0)
    return int(np.einsum("ij,ij->i", off, off).argmin())


def beam_search(points: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a greedy search from ``start`` meets, nearest first, and their squared distances.

    Missing ones are -1, at infinite distance. All queries step together: each visits its nearest unvisited nodes and keeps the
    nearest of what it held and of their neighbours, until all it holds are visited.
    """
    n, rows = len(points), len(queries)
    squares = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    nodes = np.full((rows, width), -1, np.int32)
    dist = np.full((rows, width), np.inf, np.float32)
    done = np.ones((rows, width), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = np.maximum(0, squares[start] + own - 2 * queries @ points[start])
    # the last column stands for missing neighbours
    met = np.zeros((rows, n + 1), bool)
    met[:, start] = met[:, n] = True
    active = np.arange(rows)
    while active.size:
        open_dist = np.where(done[active], np.inf, dist[active])
        visits = min(VISITS, width)
        at = np.argpartition(open_dist, visits - 1, 1)[:, :visits]
        real = np.isfinite(np.take_along_axis(open_dist, at, 1))
        going = real.any(1)
        active, at, real = active[going], at[going], real[going]
        if not active.size:
            break
        line = active[:, None]
        done[line, at] = True
        near = np.where(real[:, :, None], links[np.where(real, nodes[line, at], 0)], -1).reshape(active.size, -1)
        # a neighbour of several visited nodes is taken once
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~met[line, near]
        met[line, near] = True
        d = np.full(near.shape, np.inf, np.float32)
        r, c = np.nonzero(fresh)
        to = near[r, c]
        d[r, c] = np.maximum(0, squares[to] + own[active[r]] - 2 * np.einsum("ij,ij->i", points[to], queries[active[r]]))
        all_dist = np.concatenate((dist[active], d), 1)
        keep = np.argpartition(all_dist, width - 1, 1)[:, :width]
        dist[active] = np.take_along_axis(all_dist, keep, 1)
        nodes[active] = np.take_along_axis(np.concatenate((nodes[active], near), 1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], ~fresh), 1), keep, 1)
    order = np.argsort(dist, 1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(nodes, order, 1), -1), dist


def pruned(points: np.ndarray, nodes: np.ndarray, proposals: np.ndarray) -> np.ndarray:
    """The neighbours kept of each node's proposals (-1: none), nearest first, -1 beyond them.

    The nearest remaining proposal is kept; those that it is nearer to by the factor ``ALPHA`` than the node itself go.
    """
    proposals = np.sort(proposals, 1)
    proposals[:, 1:][proposals[:, 1:] == proposals[:, :-1]] = -1
    proposals[proposals == nodes[:, None]] = -1
    x, c = points[nodes], points[proposals]
    squares = np.einsum("ijk,ijk->ij", c, c)
    to_node = squares + np.einsum("ij,ij->i", x, x)[:, None] - 2 * np.einsum("ijk,ik->ij", c, x)
    between = squares[:, :, None] + squares[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    left = np.where(proposals < 0, np.inf, np.maximum(0, to_node))
    kept = np.full((len(nodes), DEGREE), -1, np.int32)
    every = np.arange(len(nodes))
    for k in range(DEGREE):
        pick = left.argmin(1)
        some = np.isfinite(left[every, pick])
        if not some.any():
            break
        kept[some, k] = proposals[some, pick[some]]
        left[every, pick] = np.inf
        left[(ALPHA * ALPHA * between[every, pick] <= np.maximum(0, to_node)) & some[:, None]] = np.inf
    return kept


def link_back(points: np.ndarray, links: np.ndarray, joined: np.ndarray) -> None:
    """Adds the reverse of the new nodes' edges. A node without room prunes what it has with what comes, ``DEGREE`` at a time."""
    sources = np.repeat(joined, DEGREE)
    targets = links[joined].ravel()
    sources, targets = sources[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    heads, first = np.unique(targets, return_index=True)
    place = np.arange(targets.size) - np.repeat(first, np.diff(np.append(first, targets.size)))
    for turn in range(0, int(place.max(initial=-1)) + 1, DEGREE):
        now = (place >= turn) & (place < turn + DEGREE)
        nodes, row = np.unique(targets[now], return_inverse=True)
        coming = np.full((nodes.size, DEGREE), -1, np.int32)
        coming[row, place[now] - turn] = sources[now]
        both = np.concatenate((links[nodes], coming), 1)
        full = (both >= 0).sum(1) > DEGREE
        # the missing ones sort to the end
        packed = -np.sort(-both[~full], 1)[:, :DEGREE]
        links[nodes[~full]] = packed
        for a in range(0, int(full.sum()), JOINING):
            some = np.flatnonzero(full)[a : a + JOINING]
            links[nodes[some]] = pruned(points, nodes[some], both[some])


def built(points: np.ndarray) -> np.ndarray:
    """The links of all points, which join in the order given, after the one where searches begin."""
    n, start = len(points), middle_node(points)
    links = np.full((n, DEGREE), -1, np.int32)
    order = np.concatenate(([start], np.delete(np.arange(n), start))).astype(np.int32)
    at = 1
    while at < n:
        joining = order[at : at + min(at, JOINING)]
        for a in range(0, joining.size, TOGETHER):
            nodes = joining[a : a + TOGETHER]
            proposals, _ = beam_search(points, links, start, points[nodes], BUILD_BEAM)
            links[nodes] = pruned(points, nodes, proposals)
        link_back(points, links, joining)
        at += joining.size
    return links


def answers(vectors: np.ndarray, ids: list[list[int]], links: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the (score, vec_id) of the k + 1 best rows found, best first. ``ids`` are those of each node."""
    points = lifted(vectors)
    start, asked, out = middle_node(points), asked_points(queries), []
    # a larger graph needs a wider beam for the same recall
    width = max(2 * k, int(SEARCH_BEAM * max(1, math.sqrt(len(vectors) / FEWEST))))
    for a in range(0, len(queries), TOGETHER):
        nodes, _ = beam_search(points, links, start, asked[a : a + TOGETHER], width)
        scores = (vectors[nodes] * queries[a : a + TOGETHER, None, :]).sum(2)
        for line, score in zip(nodes, scores):
            # every node yields a row at least, so the k + 1 best nodes, ties included, hold the k + 1 best rows
            some = np.flatnonzero(line >= 0)
            if some.size > k + 1:
                some = some[score[some] >= np.partition(score[some], some.size - k - 1)[some.size - k - 1]]
            rows = sorted((-float(score[i]), v) for i in some for v in ids[line[i]])
            out.append([(-s, v) for s, v in rows[: k + 1]])
    return out


# --- all shards ---


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def build_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("place", "ascending"), ("node", "ascending")])
    links = built(lifted(matrix(rows.column("vector"))))
    columns = {"pos": pa.array(range(len(links)), pa.int32()), "links": pa.array([line[line >= 0] for line in links], pa.list_(pa.int32()))}
    for name, column in columns.items():
        rows = rows.append_column(name, column)
    return rows.select(INDEX_COLUMNS)


def search_shard(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    rows = []
    if index.num_rows and queries.num_rows:
        index = index.sort_by("pos")
        lengths = index.column("links").combine_chunks().value_lengths().to_numpy()
        links = np.full((index.num_rows, DEGREE), -1, np.int32)
        links[np.arange(DEGREE) < lengths[:, None]] = index.column("links").combine_chunks().flatten().to_numpy()
        found = answers(matrix(index.column("vector")), index.column("ids").to_pylist(), links, matrix(queries.column("vector")), k)
        rows = [(q, v, s) for q, line in zip(queries.column("node").to_pylist(), found) for s, v in line]
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["node", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where("vec_id IS NOT NULL").where(whole & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row for each different vector, with the k + 1 smallest of its ids: no ranking of k can show more of them."""
    held = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    held = held.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(held.select(F.col("ids")[0].alias("node"), F.size("vector").alias("dim"), "ids", "vector", F.xxhash64("vector").alias("place")), "vector-nodes")


def graph_index(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The written index, a row for each node with its links, and the number of shards.

    A shard holds the more nodes the more there are, as each query meets every shard, but never more than a task can hold.
    """
    n, dim = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = max(1, min(max(FEWEST, int(ROOT * math.sqrt(n))), MOST, MOST_VALUES // dim))
    shards = max(1, -(-n // size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    # a number of its own, as adaptive execution would put shards together by their bytes
    graphs = dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build_shard, INDEX)
    return stored(graphs, "vector-index"), shards


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, best first, ties by ascending
    vec_id. Scores are sums of products in double precision over the vectors as given.

    ``vectors`` has vec_id and embedding. Queries are the rows of ``queries`` with the same columns, by default those whose
    vec_id is divisible by ``every``; a row with a query's own vec_id is no candidate. All rows are indexed; the search is approximate, so rows may be missed.
    Queries with the same vector are searched once.

    Null vectors or ids, vectors that are all zero or hold a null, an infinity or a NaN take no part, nor do empty ones. Vectors of
    different lengths do not meet. Of rows that share a vec_id the least vector counts. Equal vectors, however many, are one node. With
    fewer candidates than k, all that the search reaches are returned; empty tables give no rows. Other columns are not read.
    """
    rows = stored(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else usable(queries)
    nodes = nodes_of(rows, k)
    index, shards = graph_index(nodes)
    # queries with one vector share a key, the smallest of their ids
    asked = asked.withColumnRenamed("vec_id", "query_id")
    search = stored(asked.groupBy("vector").agg(F.min("query_id").alias("node")), "vector-queries")
    blocks = max(1, -(-search.count() // QUERY_BLOCK))
    keys = ["dim", "shard", "block"]
    sent = search.select(
        "node", "vector", F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    )
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = 2 * shards * blocks
    met = graphs.repartition(tasks, *keys).groupBy(*keys).cogroup(sent.repartition(tasks, *keys).groupBy(*keys))
    found = met.applyInArrow(lambda index, queries: search_shard(index, queries, k), FOUND)
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    best = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    owners = asked.join(search, "vector").select("query_id", "node")
    others = F.slice(F.filter("best", lambda b: b.vec_id != F.col("query_id")), 1, k)
    ranks = owners.join(best, "node").select("query_id", F.posexplode(others).alias("at", "b"))
    return ranks.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
