"""Embedding near-dedup by an exact metric range join.

Vectors are compared within their label by cosine in double precision; on unit vectors that is Euclidean
distance up to eps = sqrt(2 - 2 * threshold). Equal vectors collapse to one row with a weight first. Each
label has pivots, one for about CELL vectors and at most MOST_PIVOTS; a vector's home is the cell of its nearest pivot. By the
triangle inequality a neighbour of a vector at home in a cell of radius r is within r + eps of the cell's
pivot, and within eps of the plane between its own pivot and that one: vectors that are get a copy in the
cell. So each home vector meets all its neighbours in its own cell, and cells join independently.

A cell's home vectors are dealt to blocks of about BLOCK rows; the cell's vectors stream past each block, so a
vector is copied once per block that it may matter to.
A task holds one block and one batch, however large the label or cell, and compares them in tiles. Per tile, links are counted by
matrix product and thinned to a spanning set, so the links that leave a task are at most its rows.

Edge cases: a null label, or a vector that is null, zero or holds null or non-finite components, links with
nothing and is its own component; vectors of different lengths do not link; repeated rows are copies that
link with each other; a null id counts as a vector and names no component, unless all ids of a component are null,
whose component_id is null then; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, cut, quoted

#: The least cosine; vectors of a cell, about; pivots of a label at most; rows of a salt; home rows of a block; rows of a tile.
THRESHOLD, CELL, MOST_PIVOTS, GROUP, BLOCK, TILE = 0.93, 4096, 512, 16_384, 32_768, 4096
#: Slack for rounding when cells are chosen; links themselves are decided by the cosine alone.
SLACK = 1e-6


def usable(vector: str) -> Column:
    """Whether a vector column can be compared: it is not null, all its components are finite and not all are zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, as doubles."""
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _runs(batch: pa.RecordBatch, *keys: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with equal key columns."""
    if batch.num_rows:
        data = [np.asarray(batch.column(k)) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in data], axis=0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        yield from zip(edges, edges[1:], strict=False)


def spanning(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A few links (id, id) with the same components as the marked pairs of a row/column matrix."""
    out: list[tuple[int, int]] = []
    fresh_rows, fresh_columns = links.any(axis=1), links.any(axis=0)
    for start in np.flatnonzero(fresh_rows):
        if not fresh_rows[start]:
            continue
        frontier = np.array([start])
        fresh_rows[start] = False
        while len(frontier):
            reached = np.flatnonzero(links[frontier].any(axis=0) & fresh_columns)
            fresh_columns[reached] = False
            out += [(int(rows[start]), int(c)) for c in columns[reached]]
            frontier = np.flatnonzero(links[:, reached].any(axis=1) & fresh_rows) if len(reached) else reached
            fresh_rows[frontier] = False
            out += [(int(rows[start]), int(r)) for r in rows[frontier]]
    return [(a, b) for a, b in out if a != b]


def _beside(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows and their part's pivots in one stream: each (part, salt) run begins with a row that has the pivots.

    A part has one salt for about GROUP of its rows, so a hot label is spread over many runs.
    """
    salts = cells.select(F.col("part").alias("_part"), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)).alias("_salts"))
    left = rows.join(salts, F.col("part") == F.col("_part")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("_salts"))).drop("_part", "_salts")
    heads = cells.join(salts, F.col("part") == F.col("_part")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    both = left.unionByName(heads.select("part", "salt", "pivots"), allowMissingColumns=True)
    both = both.select("part", "salt", "pivots", "node", "weight", "vector", *(["pivot"] if "pivot" in rows.columns else []))
    return both.repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("pivots").isNull())


def _stream(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(the pivots that hold, up to rows of the rows that follow them)."""
    pivots: list = []
    for batch in batches:
        heads = np.asarray(batch.column(2).is_valid())
        at = 0
        for stop in [*np.flatnonzero(heads).tolist(), batch.num_rows]:
            while at < stop:
                part = batch.slice(at, min(rows, stop - at, max(64, 65_536 // max(1, len(pivots)))))
                yield pivots, part
                at += part.num_rows
            if stop < batch.num_rows:
                pivots, at = batch.column(2)[stop].as_py(), stop + 1


def _cells(classes: DataFrame, eps: float, cell: int) -> DataFrame:
    """(part, pivot, block, guest, node, weight, vector): every class at home, and its copies wherever it may matter."""
    order = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("node"), "node"))
    sizes = classes.groupBy(F.col("part").alias("_part")).agg(F.count("*").alias("n"))
    few = classes.select("part", "node", order.alias("pivot")).filter(F.col("pivot") <= MOST_PIVOTS)  # bounded before the vectors are fetched
    few = few.join(sizes, F.col("part") == F.col("_part")).filter(F.col("pivot") <= F.ceil(F.col("n") / cell)).select(F.col("node").alias("_node"), "pivot", "n")
    chosen = classes.join(few, F.col("node") == F.col("_node")).groupBy("part").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pivot", "vector"))).alias("pivots"))
    chosen = cut(chosen)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivots, part in _stream(batches, 4096):
            dots = unit(matrix(part.column(5))) @ unit(np.array([x["vector"] for x in pivots], np.float64)).T
            home = dots.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(home)), home]))
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[3:6], pa.array(home.astype(np.int64)), pa.array(far)], names=["part", "node", "weight", "vector", "pivot", "far"])

    homes = cut(_beside(classes, chosen).mapInArrow(nearest, "part long, node long, weight long, vector array<double>, pivot long, far double"))
    radius = homes.groupBy(F.col("part").alias("_part"), "pivot").agg(F.max("far").alias("r"), F.count("*").alias("n_home"))
    radius = radius.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("pivot", F.struct("r", "n_home")))).alias("of"))
    known = F.transform("pivots", lambda x, i: F.struct(x["vector"].alias("vector"), F.try_element_at("of", i.cast("long")).alias("of")))
    cells = cut(chosen.join(radius, F.col("part") == F.col("_part")).select("part", "n", known.alias("pivots")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p = None, None
        for pivots, part in _stream(batches, 1024):
            if pivots is not last:
                last, p = pivots, unit(np.array([x["vector"] for x in pivots], np.float64))
                radius = np.array([-np.inf if x["of"] is None else x["of"]["r"] for x in pivots])
                blocks = np.array([0 if x["of"] is None else -(-x["of"]["n_home"] // max(cell, BLOCK)) for x in pivots])
                between = np.sqrt(np.maximum(1e-300, 2 - 2 * p @ p.T))
            node, x, home = np.asarray(part.column(3)), unit(matrix(part.column(5))), np.asarray(part.column(6))
            dots, every = x @ p.T, np.arange(len(x))
            near = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius + eps + SLACK
            near &= (dots[every, home][:, None] - dots) <= (eps + SLACK) * between[home] + SLACK
            near[every, home] = True
            row, pivot = np.nonzero(near)
            times = blocks[pivot]  # a copy for each block of home rows in the cell
            row, pivot = np.repeat(row, times), np.repeat(pivot, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            guest = (home[row] != pivot) | (np.abs(node[row]) % np.maximum(1, blocks[pivot]) != block)
            picked = part.take(pa.array(row))
            columns = [picked.column(0), pa.array(pivot.astype(np.int64)), pa.array(block.astype(np.int64)), pa.array(guest), *picked.columns[3:6]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "pivot", "block", "guest", "node", "weight", "vector"])

    schema = "part long, pivot long, block long, guest boolean, node long, weight long, vector array<double>"
    return _beside(homes.drop("far"), cells).mapInArrow(spread, schema)


def _join(cells: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, other, n): n of another node's weight added to node's links, or a link node - other (n is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, x, weights = None, None, None, None
        for batch in batches:
            for a, b in _runs(batch, 0, 1, 2):
                part = batch.slice(a, b - a)
                now = tuple(part.column(k)[0].as_py() for k in (0, 1, 2))
                guest, node, weight, vectors = np.asarray(part.column(3)), np.asarray(part.column(4)), np.asarray(part.column(5)), unit(matrix(part.column(6)))
                if now != key:
                    key, nodes, x, weights = now, node[:0], vectors[:0], weight[:0]
                links: list[tuple[int, int]] = []
                counts: list[tuple[int, int]] = []

                def meet(left: np.ndarray, lx: np.ndarray, right: np.ndarray, rx: np.ndarray, rw: np.ndarray, counts: list = counts, links: list = links) -> None:
                    for at, low in product(range(0, len(right), 1024), range(0, len(left), TILE)):
                        block, tile = slice(at, at + 1024), slice(low, low + TILE)
                        near = (lx[tile] @ rx[block].T >= threshold) & (left[tile, None] != right[None, block])
                        if near.any():
                            total = near @ rw[block]
                            counts += [(int(n), int(t)) for n, t in zip(left[tile][total > 0], total[total > 0], strict=True)]
                            links += spanning(near, left[tile], right[block])

                fresh = ~guest
                if fresh.any():  # home rows come first: the new ones meet those before them, and those them
                    meet(nodes, x, node[fresh], vectors[fresh], weight[fresh])
                    nodes, x, weights = np.concatenate([nodes, node[fresh]]), np.concatenate([x, vectors[fresh]]), np.concatenate([weights, weight[fresh]])
                    meet(node[fresh], vectors[fresh], nodes, x, weights)
                if guest.any():
                    meet(nodes, x, node[guest], vectors[guest], weight[guest])
                columns = [[n for n, _ in counts] + [u for u, _ in links], [None] * len(counts) + [v for _, v in links], [t for _, t in counts] + [None] * len(links)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other", "n"])

    sorted_rows = cells.repartition("part", "pivot", "block").sortWithinPartitions("part", "pivot", "block", "guest")
    return sorted_rows.mapInArrow(run, "node long, other long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per vector.

    n_links counts the other vectors with cosine >= threshold and the same label; component_id is the least
    id that links reach, the own one included; kept marks vec_id = component_id.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("vector"), F.col(quoted(label_col)).alias("label"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull() & usable("vector"), F.col("vector").cast("array<double>")))
    good = rows.filter("vector is not null")
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    # a class is named by its least id; one of null ids alone gets a negative name of its own
    node = F.coalesce(F.col("least").cast("long"), -1 - F.pmod(F.xxhash64("label", "vector"), F.lit(2**62)))
    classes = cut(classes.select(F.xxhash64("label", F.size("vector")).alias("part"), node.alias("node"), "label", "least", "weight", "vector"))
    joined = cut(_join(_cells(classes.select("part", "node", "weight", "vector"), eps, cell), threshold))
    counts = joined.filter("n is not null").groupBy(F.col("node").alias("_n")).agg(F.sum("n").alias("n"))
    member = connected_components(joined.filter("n is null"), "node", "other")
    found = classes.join(counts, F.col("node") == F.col("_n"), "left").drop("_n").join(member.withColumnRenamed("node", "_m"), F.col("node") == F.col("_m"), "left")
    found = found.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    # only components whose root is such a name of its own look it up
    names = found.filter("root < 0").groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    columns = ["_label", "_vector", "n_links", "component_id"]
    found = found.filter("root >= 0").withColumn("component_id", F.col("root")).select(*columns).union(found.filter("root < 0").join(names, F.col("root") == F.col("_root"), "left").select(*columns))
    marked = good.join(found, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")))
    marked = marked.select("id", "n_links", "component_id").union(rows.filter("vector is null").select("id", F.lit(0).cast("long"), F.col("id").cast("long")))
    return marked.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
