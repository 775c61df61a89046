"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Nearness is the inner product. Equal vectors are indexed once, with the least ids of their copies. Vectors are dealt
by a hash of the id to shards of at most SHARD_VALUES components or SHARD_LEAST rows, those of very different magnitude
(bands of 2^BAND) apart. A shard's graph links directions: a few nested layers of flat neighbour arrays, built
in batches, where each batch searches the graph so far, keeps neighbours that lie in different directions, and is
linked back. A search walks that graph by inner product with the vectors themselves; it enters through the
upper layers and through the best of the shard's longest vectors (one in LOUD), so that a few long
vectors that lie in no near direction are found too. The index is one row per shard, kept in the checkpoint folder. Queries
are packed into blocks; a task holds one shard and one block at a time, and at most SPLIT blocks go to one task.

Every usable row is indexed. Scores are computed in double precision from the original vectors.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null
id; vectors of different lengths are not compared; ties, at the last rank too, go to the smaller id of those found; repeated rows
of one id are candidates of their own but a query never meets its own id; with fewer candidates than asked for, all are returned;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut, quoted
from .metric_join import matrix, unit, usable

#: Components and least rows of a shard; links of a node above the ground layer (twice that on it); beam widths; log2 width of a magnitude band.
SHARD_VALUES, SHARD_LEAST, LINKS, BUILD_BEAM, SEARCH_BEAM, BAND = 2**21, 8192, 16, 64, 512, 16
#: One in how many vectors, the longest, may be an entry; entries taken of them; queries of a block; blocks of a task.
LOUD, ENTRIES, BLOCK, SPLIT = 16, 64, 1024, 64


def _at_once(dimensions: int) -> int:
    """Queries that go in step, so that the vectors of their candidates fit in some 30 MB."""
    return max(16, 16_384 // dimensions)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes by inner product, (ids, scores) sorted downwards, -1 and -inf where fewer; queries go in step.

    links: neighbour ids by node, -1 for none. entry: start nodes by query, -1 for none. expand: nodes opened at a time.
    """
    n, every = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(links) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids, scores, closed = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.ones((n, width), bool)
    fresh = np.where(entry < len(links), entry, -1)
    live = np.arange(n)
    while len(live):
        rows = live[:, None]
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh[seen[rows, fresh]] = -1
        seen[rows, fresh] = True
        found = np.einsum("qd,qkd->qk", q[live], x[fresh])
        found[fresh < 0] = -np.inf
        all_ids, all_scores = np.concatenate([ids[live], fresh], axis=1), np.concatenate([scores[live], found], axis=1)
        all_closed = np.concatenate([closed[live], fresh < 0], axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        ids[live], scores[live], closed[live] = all_ids[at, best], all_scores[at, best], all_closed[at, best]
        open_scores = np.where(closed[live], -np.inf, scores[live])
        going = open_scores.max(axis=1) > -np.inf
        live, open_scores = live[going], open_scores[going]
        if len(live):
            at = np.arange(len(live))[:, None]
            best = np.argpartition(-open_scores, min(expand, width) - 1, axis=1)[:, :expand]
            chosen = np.where(open_scores[at, best] > -np.inf, ids[live[:, None], best], -1)
            closed[live[:, None], best] = True
            fresh = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1).astype(np.int64)
    order = np.argsort(-scores, axis=1, kind="stable")
    return ids[every, order], scores[every, order]


def spread_out(x: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, sorted by falling score, up to keep ids: first those nearer to the row's
    node than to any already kept, then the best of the others."""
    near = x[ids]
    between = near @ near.transpose(0, 2, 1)
    valid, top = ids >= 0, np.full(ids.shape, -np.inf, np.float32)
    kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        take = valid[:, c] & (count < keep) & (scores[:, c] > top[:, c])
        kept[:, c] = take
        count += take
        top = np.where(take[:, None], np.maximum(top, between[:, c]), top)
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """Adds to each neighbour of the nodes a link to the node; where that is too many, spread_out decides."""
    cap = links.shape[1]
    source, target = np.repeat(nodes, cap), links[nodes].ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    score = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-score, target))
    source, target = source[order], target[order]
    new = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, np.int64)
    place = np.arange(len(target)) - np.repeat(new, np.diff(np.append(new, len(target))))
    group = np.cumsum(np.isin(np.arange(len(target)), new)) - 1
    width = 2 * cap
    added = np.full((len(new), width), -1, np.int64)
    fits = place < width
    added[group[fits], place[fits]] = source[fits]
    wanted = target[new]
    for at in range(0, len(wanted), 512):
        t, more = wanted[at : at + 512], added[at : at + 512]
        ids = np.concatenate([links[t].astype(np.int64), more], axis=1)
        ids = np.sort(ids, axis=1)[:, ::-1].copy()
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        scores = np.where(ids >= 0, np.einsum("qd,qkd->qk", x[t], x[ids]), -np.inf).astype(np.float32)
        order = np.argsort(-scores, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        widest = int((ids >= 0).sum(axis=1).max(initial=0))
        links[t] = spread_out(x, ids[:, : max(widest, 1)], scores[:, : max(widest, 1)], cap)


class Graph:
    """Nested layers over rows sorted by falling level: layer k holds the first len(layers[k]) rows."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """x: rows of one norm, sorted by falling level."""
        graph = cls(x, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            size = int((levels >= level).sum())
            above = len(graph.layers[0]) if graph.layers else 0
            layer = np.full((size, 2 * links if level == 0 else links), -1, np.int32)
            done = min(size, max(above, 256))
            dots = x[:done] @ x[:done].T
            np.fill_diagonal(dots, -np.inf)
            cls._place(x, layer, np.arange(done), np.broadcast_to(np.arange(done), dots.shape), dots, links, beam)
            while done < size:
                nodes = np.arange(done, min(size, done + min(1024, done)))
                ids, scores = np.full((len(nodes), beam), -1, np.int64), np.full((len(nodes), beam), -np.inf, np.float32)
                for at in range(0, len(nodes), _at_once(x.shape[1])):
                    part = slice(at, at + _at_once(x.shape[1]))
                    ids[part], scores[part] = beam_search(x, layer[:done], x[nodes[part]], graph.descend(x[nodes[part]]), beam)
                dots = x[nodes] @ x[nodes].T
                np.fill_diagonal(dots, -np.inf)
                cls._place(x, layer, nodes, np.concatenate([ids, np.broadcast_to(nodes, dots.shape)], axis=1), np.concatenate([scores, dots], axis=1), links, beam)
                done += len(nodes)
            graph.layers.insert(0, layer)
        return graph

    @staticmethod
    def _place(x: np.ndarray, layer: np.ndarray, nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, links: int, beam: int) -> None:
        for at in range(0, len(nodes), 512):
            part = slice(at, at + 512)
            best = np.argsort(-scores[part], axis=1, kind="stable")[:, :beam]
            i, s = np.take_along_axis(ids[part], best, axis=1), np.take_along_axis(scores[part], best, axis=1)
            chosen = spread_out(x, np.where(s > -np.inf, i, -1), s, links)
            layer[nodes[part], :links] = chosen
        _link_back(x, layer, nodes)

    def descend(self, q: np.ndarray, above: int = 0) -> np.ndarray:
        """Start nodes from the layers from above upwards, the highest first."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in self.layers[above:][::-1]:
            ids, _ = beam_search(self.x, layer, q, entry, 8)
            entry = ids[:, :4]
        return entry

    def search(self, q: np.ndarray, v: np.ndarray, loud: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Node ids by query, those of the largest inner products with v's rows, -1 where fewer than beam; loud: nodes that may be entries."""
        entry, width = self.descend(q, 1), min(ENTRIES, len(loud))
        best = np.argpartition(-(q @ v[loud].T), width - 1, axis=1)[:, :width]
        return beam_search(v, self.layers[0], q, np.concatenate([entry, loud[best]], axis=1), beam, 16)[0]


def levels_of(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Levels from a hash of the ids, so that rebuilt shards are equal: each is kept with odds 1 / links."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.minimum(8, (-np.log(u) / math.log(links)).astype(np.int64))


_INDEX = "shard long, node binary, vector binary, sizes array<int>, links binary"


def build_index(classes: DataFrame) -> DataFrame:
    """One row per shard from (shard, node, vector): node ids, vectors and all layers' links as flat arrays."""

    def one(shard: int, node: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        levels = levels_of(node)
        order = np.lexsort((node, -levels))
        node, v, levels = node[order], v[order], levels[order]
        graph = Graph.build(unit(v).astype(np.float32), levels)
        flat = np.concatenate([layer.ravel() for layer in graph.layers])
        row = [[shard], [node.tobytes()], [v.tobytes()], [[n for layer in graph.layers for n in layer.shape]], [flat.tobytes()]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["shard", "node", "vector", "sizes", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, vectors = None, [], []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != shard and nodes:
                    yield one(shard, np.concatenate(nodes), np.concatenate(vectors))
                    nodes, vectors = [], []
                shard = int(keys[a])
                nodes.append(np.asarray(batch.column(1))[a:b])
                vectors.append(matrix(batch.column(2).slice(a, b - a)))
        if nodes:
            yield one(shard, np.concatenate(nodes), np.concatenate(vectors))

    dealt = classes.select("shard", "node", "vector").repartition("shard").sortWithinPartitions("shard", "node")
    return cut(dealt.mapInArrow(run, _INDEX))


def search_index(index: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query, node, score): each shard's k best for the queries of each (shard, split, queries, asked) row of blocks.

    index has a row (shard, split, ...) for every split that blocks has; ties go to the smaller node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, node, v, scaled, loud = None, None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(3)[i].is_valid:
                    node = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                    v = np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(len(node), -1)
                    sizes, flat = batch.column(4)[i].as_py(), np.frombuffer(batch.column(5)[i].as_py(), np.int32)
                    layers, used = [], 0
                    for n, width in zip(sizes[::2], sizes[1::2], strict=True):
                        layers.append(flat[used : used + n * width].reshape(n, width))
                        used += n * width
                    scaled = v / np.abs(v).max()
                    loud = np.argsort(-(scaled * scaled).sum(axis=1), kind="stable")[: -(-len(v) // LOUD)]
                    graph, scaled = Graph(unit(v).astype(np.float32), layers), scaled.astype(np.float32)
                    continue
                queries, asked = np.asarray(batch.column(6)[i].values), matrix(batch.column(7)[i].values)
                for at in range(0, len(queries), _at_once(v.shape[1])):
                    part = slice(at, at + _at_once(v.shape[1]))
                    q = asked[part]
                    ids = np.sort(graph.search(unit(q).astype(np.float32), scaled, loud, max(SEARCH_BEAM, k)), axis=1)
                    scores = np.where(ids >= 0, np.einsum("qd,qkd->qk", q, v[ids]), -np.inf)
                    order = np.argsort(np.where(ids >= 0, node[ids], np.iinfo(np.int64).max), axis=1, kind="stable")
                    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
                    row, column = np.nonzero(np.take_along_axis(ids, order, axis=1) >= 0)
                    best = order[row, column]
                    columns = [queries[part][row], node[ids[row, best]], scores[row, best]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "node", "score"])

    stream = index.select("shard", "split", "node", "vector", "sizes", "links").unionByName(blocks.select("shard", "split", "queries", "asked"), allowMissingColumns=True)
    stream = stream.repartition("shard", "split").sortWithinPartitions("shard", "split", F.col("vector").isNull())
    return stream.mapInArrow(run, "query long, node long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest other rows of each row whose id is divisible by every."""
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("vector"))
    rows = rows.filter(usable("vector") & F.col("id").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    classes = rows.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    largest = F.array_max(F.transform("vector", F.abs))
    kinds = {"_dim": F.size("vector"), "_band": F.floor(F.log2(largest) / BAND)}
    classes = classes.withColumn("node", F.col("members")[0]).withColumns(kinds)
    size = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(SHARD_LEAST), F.lit(SHARD_VALUES) / F.col("_dim"))
    shards = classes.groupBy("_dim", "_band").agg(F.ceil(F.count("*") / size).alias("shards"))
    shards = cut(shards.select(F.col("_dim").alias("_d"), F.col("_band").alias("_b"), "shards"))
    sized = classes.join(shards, (F.col("_dim") == F.col("_d")) & (F.col("_band") == F.col("_b")))
    classes = cut(sized.select("node", "vector", "members", "_dim", F.xxhash64("_dim", "_band", F.pmod(F.xxhash64("node"), F.col("shards"))).alias("shard")))
    queries = rows.filter(F.col("id") % every == 0)
    named = queries.join(classes.select(F.col("vector").alias("_v"), F.col("node").alias("query")), F.col("vector") == F.col("_v")).select("id", "query")
    named = cut(named)
    asked = cut(classes.join(named.select("query").distinct(), F.col("node") == F.col("query"), "left_semi").select("_dim", F.col("node").alias("query"), "vector"))
    counts = asked.groupBy(F.col("_dim").alias("_d")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    packed = asked.join(counts, F.col("_dim") == F.col("_d")).withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), F.col("blocks")))
    packed = packed.groupBy("_dim", "block").agg(F.sort_array(F.collect_list(F.struct("query", "vector"))).alias("_q"))
    packed = packed.select("_dim", F.floor(F.col("block") / SPLIT).alias("split"), F.col("_q.query").alias("queries"), F.col("_q.vector").alias("asked"))
    every_shard = shards.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select("_d", F.xxhash64("_d", "_b", "_s").alias("shard"))
    blocks = packed.join(every_shard, F.col("_dim") == F.col("_d")).select("shard", "split", "queries", "asked")
    splits = every_shard.join(counts.withColumnRenamed("_d", "_e"), F.col("_d") == F.col("_e"))
    splits = splits.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / SPLIT))).alias("split"))
    index = build_index(classes).join(splits, F.col("shard") == F.col("_shard"))
    found = search_index(index, blocks, k + 1)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    found = found.withColumn("_n", best).filter(F.col("_n") <= k + 1).drop("_n")
    copies = found.join(classes.select(F.col("node").alias("_node"), "members"), F.col("node") == F.col("_node")).select("query", "score", F.explode("members").alias("hit"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hit"))
    lists = copies.withColumn("_n", best).filter(F.col("_n") <= k + 1).groupBy(F.col("query").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("_n", "hit", "score"))).alias("hits"))
    joined = named.join(lists, F.col("query") == F.col("_q"))
    others = F.slice(F.filter("hits", lambda h: h["hit"] != F.col("id")), 1, k)
    out = joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "_hit"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.hit").alias(id_col), F.col("_hit.score").alias("score"))
