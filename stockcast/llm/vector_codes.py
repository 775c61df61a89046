"""Vector code compression: product codes with integer codebooks, assigned exactly.

Each component x becomes the integer floor(SCALE * x); a vector is cut into PARTS consecutive parts of equal length, and
a part's code is the index of its nearest codebook entry. Codebooks start as the parts of the first ENTRIES vectors by id,
and ROUNDS times every entry becomes the componentwise floor of the mean of its parts.

Distances are screened by a float32 matrix product. A score's rounding error is at most a known multiple of the two
norms, so each score is an interval; an entry stays possible if its interval reaches down to the least upper end. Where one
entry is left, it is the nearest; of the others, the distances are computed anew in int64, and the least index wins
a tie. So all codes are those of exact arithmetic, in whatever order a matrix product adds.

A round is one scan: a task adds up its own parts entry by entry, so that only sums, at most ENTRIES * PARTS rows a task, are
shuffled, and the codebooks, ENTRIES integers a component, go through the driver. The input is read ROUNDS + 3 times and
neither sorted nor copied; write one that is dear to compute to a table first.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; vectors of another
length have codebooks of their own (all codebooks together may have MOST_INTEGERS integers, else ValueError); lengths that
PARTS does not divide count as filled up with zeros; an empty vector has code 00 throughout and error 0; a null id is the last;
rows that share an id are ordered by their components, and repeated rows are vectors of their own; with fewer than ENTRIES vectors, there are as
many entries as vectors; integers are held within the magnitude at which a squared distance still fits a long (components
up to 32,768 at 64 dimensions, more at fewer); a sum of errors that fits no long is null; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import map_arrow, quoted

#: What a component is multiplied by; parts of a vector; entries of a part's codebook; rounds that move the entries.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers that all codebooks together may have; parts that are compared at once.
MOST_INTEGERS, BLOCK = 1 << 22, 4096

#: Codebooks by vector length: one array (PARTS, entries, part length) each.
Books = dict[int, np.ndarray]


def integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their integers) for each length among the vectors that are kept."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    values = np.asarray(pc.fill_null(lists.flatten(), math.nan))
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for d in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            limit = math.isqrt((1 << 60) // max(1, d))
            out = np.zeros((int(fine.sum()), -(-d // PARTS) * PARTS), np.int64)
            with np.errstate(over="ignore"):
                out[:, :d] = np.clip(np.floor(x[fine] * SCALE), -limit, limit)
            yield d, rows[fine], out


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each row of x the index of the nearest row of entries, the least one of those equally near; integers, exactly.

    A score |c|^2 - 2 x.c lacks only the row's own |x|^2. The product's float32 error is at most (w + 2) u / (1 - (w + 2) u) times
    |x| |c| for w components and u = 2^-24, whatever the order of its sums; doubles add a relative 2^-48 at most.
    """
    w = x.shape[1]
    if not w or len(entries) == 1:
        return np.zeros(len(x), np.int64)
    u = (w + 2) * 2.0**-24
    gamma = u / (1 - u) if u < 0.5 else math.inf
    real = entries.astype(np.float64)
    square = (real * real).sum(axis=1)
    size = np.sqrt(square)
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        block = x[at : at + BLOCK]
        dot = (block.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
        score = square - 2 * dot
        own = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1))
        slack = 2.0 * gamma * 1.000001 * own[:, None] * size + 2.0**-48 * (square + 2 * np.abs(dot)) if math.isfinite(gamma) else np.full(score.shape, math.inf)
        possible = score - slack <= (score + slack).min(axis=1, keepdims=True)
        best = possible.argmax(axis=1)
        open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
        if len(open_rows):
            row, entry = np.nonzero(possible[open_rows])
            exact = np.full((len(open_rows), len(entries)), np.iinfo(np.int64).max)
            exact[row, entry] = squared(block[open_rows[row]], entries[entry])
            best[open_rows] = exact.argmin(axis=1)  # the first of equals
        out[at : at + BLOCK] = best
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in int64."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The code of each row: an index for every part."""
    parts = x.reshape(len(x), PARTS, -1)
    return np.stack([nearest(np.ascontiguousarray(parts[:, p]), books[p]) for p in range(PARTS)], axis=1)


def _first_vectors(vectors: DataFrame) -> Books:
    """The starting codebooks: each task sends its own first ENTRIES vectors of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for d, rows, x in integers(batch.column(1)):
                ids = batch.column(0).take(pa.array(rows))
                order = pc.array_sort_indices(ids, null_placement="at_end")
                last = ids[order[min(ENTRIES, len(order)) - 1].as_py()]
                # those that tie with the last of these by id take part as well
                some = np.asarray(pc.fill_null(pc.less_equal(ids, last), False)) if last.is_valid else np.ones(len(ids), bool)
                found = [((i is None, i), v) for i, v in zip(ids.filter(pa.array(some)).to_pylist(), x[some].tolist(), strict=True)]
                least[d] = sorted([*least.get(d, []), *found])[:ENTRIES]
        if kind is not None:
            rows = [(d, i, v) for d, found in least.items() for (_, i), v in found]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), kind, pa.list_(pa.int64())), strict=True)], names=["d", "id", "v"])

    found = map_arrow(vectors, run, T.StructType([T.StructField("d", T.LongType()), T.StructField("id", vectors.schema[0].dataType), T.StructField("v", T.ArrayType(T.LongType()))]))
    for keys in (("d", F.pmod(F.xxhash64("id", "v"), F.lit(64))), ("d",)):
        found = found.withColumn("entry", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_last(), "v")) - 1).filter(F.col("entry") < ENTRIES)
    books: dict[int, list[tuple[int, list[int]]]] = {}
    total = 0
    for d, entry, v in found.select("d", "entry", "v").toLocalIterator():
        total += len(v)
        if total > MOST_INTEGERS:
            raise ValueError(f"the codebooks of all vector lengths have more than {MOST_INTEGERS} integers")
        books.setdefault(d, []).append((entry, v))
    return {d: np.array([v for _, v in sorted(b)], np.int64).reshape(len(b), PARTS, -1).transpose(1, 0, 2).copy() for d, b in books.items()}


def _moved(vectors: DataFrame, books: Books) -> Books:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros(b.shape, np.int64) for d, b in books.items()}
        counts = {d: np.zeros(b.shape[:2], np.int64) for d, b in books.items()}
        for batch in batches:
            for d, _, x in integers(batch.column(0)):
                code, parts = assign(x, books[d]), x.reshape(len(x), PARTS, -1)
                for p in range(PARTS):
                    order = np.argsort(code[:, p], kind="stable")
                    used, starts = np.unique(code[order, p], return_index=True)
                    sums[d][p, used] += np.add.reduceat(parts[order, p], starts, axis=0)
                    counts[d][p] += np.bincount(code[:, p], minlength=counts[d].shape[1])
        rows = [(d, p, e, int(counts[d][p, e]), sums[d][p, e].tolist()) for d in books for p, e in zip(*map(np.ndarray.tolist, np.nonzero(counts[d])), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.list_(pa.int64())], strict=True)], names=["d", "part", "entry", "n", "sums"])

    added = vectors.select("c1").mapInArrow(run, "d long, part long, entry long, n long, sums array<long>")
    each = added.select("d", "part", "entry", "n", F.posexplode("sums").alias("place", "sum"))
    each = each.groupBy("d", "part", "entry", "place").agg(F.sum(F.col("sum").cast("decimal(38, 0)")).alias("sum"), F.sum("n").alias("n"))
    out = {d: b.copy() for d, b in books.items()}
    for d, part, entry, place, total, n in each.collect():  # as many as the codebooks have integers
        out[d][part, entry, place] = int(total) // n  # floors go down
    return out


def digest(book: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Books:
    """The codebooks of each vector length."""
    source = vectors.select(quoted(id_col), quoted(vector_col)).toDF("c0", "c1")
    books = _first_vectors(source)
    for _ in range(rounds if books else 0):
        books = _moved(source, books)
    return books


def encode(vectors: DataFrame, books: Books, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, label, code, error, codebooks_sha256), one row per kept vector; label is label_col's value."""
    told = {d: digest(b) for d, b in books.items()}
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in integers(batch.column(2)):
                code, own = assign(x, books[d]), pa.array(rows)
                error = squared(x, books[d][np.arange(PARTS), code].reshape(len(x), -1))
                columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(["".join(r) for r in digits[code].tolist()], pa.string()), pa.array(error), pa.array([told[d]] * len(x), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "label", "code", "error", "codebooks_sha256"]
    source = vectors.select(quoted(id_col), quoted(label_col), quoted(vector_col))
    fields = [source.schema[0], T.StructField("label", source.schema[1].dataType), *T._parse_datatype_string("code string, error long, codebooks_sha256 string")]
    return map_arrow(source, run, T.StructType(fields))


def decode(codes: DataFrame, books: Books, length: int, code_col: str = "code") -> DataFrame:
    """codes with a column decoded: the doubles that each code of a vector of that length stands for."""
    book = books[length]
    entry = [F.conv(F.substring(F.col(quoted(code_col)), 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    known = [F.array(*(F.array(*(F.lit(v / SCALE) for v in e)) for e in part)) for part in book.tolist()]
    whole = F.concat(*(F.element_at(known[p], entry[p] + 1) for p in range(PARTS)))
    return codes.withColumn("decoded", F.slice(whole, 1, length))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256), one row per kept vector; label_error is the sum over equal labels, nulls together."""
    coded = encode(vectors, fit(vectors, id_col, vector_col, rounds), id_col, vector_col, label_col)
    total = F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)").alias("label_error")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col(quoted(id_col)), "code", "error", "label_error", "codebooks_sha256")
