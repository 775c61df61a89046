"""SimHash near-dedup with deletion-variant signatures.

A document's fingerprint has a bit set if over half of its shingle hashes (XXH64, seed 42) have it. Two
fingerprints link if they differ in at most three bits. The 64 bits are cut into two segments; three
differences leave one segment with at most one, so indexing each segment with one bit left out - 32
variants a segment - brings every linked pair together in some variant, by equality alone.

Documents collapse to distinct fingerprints first, so copies cost nothing. Rows of a variant arrive sorted
by it and are compared as a stream. A variant that more than GROUP fingerprints share is not compared
there: its rows are cut again the same way, over the bits that the variant leaves open (32, then 16),
until at most 2^11 fingerprints can share all fixed bits. What a variant yields is a spanning set of its
links - one row per linked fingerprint - and components are joined up in Spark.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; a null id has its fingerprint and component but names none
(components are named by the least non-null id); repeated ids are rows of their own; an empty table gives an
empty result; texts of any length are read whole, in pieces; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import CONTENT, by_content, connected_components, cut, map_arrow, one_of_each, quoted

MAX_BITS, GROUP = 3, 4096
#: Fingerprints that one task makes variants of, about, and tasks at most.
EXPANDED, MOST_TASKS = 16_384, 4000
_PIECES = 65_536


def words_of(text: str) -> list[bytes]:
    """A-Z are lower-cased; words are separated by ASCII white space."""
    return text.encode().lower().split()


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Unsigned; of the words of a text."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECES):
        block = words[at : at + _PIECES + shingle - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        digests = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long."""
    source = docs.select(quoted(id_col), quoted(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(words_of(x.as_py() or ""), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return map_arrow(source, run, T.StructType([source.schema[0], T.StructField("fp", T.LongType())]))


def variants(fp: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All one-wildcard variants of the two segments of width bits that begin at bit low.

    Returns (row, variant, low bit of what is left open), one entry per variant: row is an index of fp.
    """
    u = fp.view(np.uint64)
    rows, keys, opens = [], [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        segment = (u >> (low + half * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        for p in range(width):
            tag = np.uint64((half * width + p) << width)
            rows.append(every)
            keys.append((segment & np.uint64(~(1 << p) & ((1 << width) - 1))) | tag)
            opens.append(low + (1 - half) * width)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(opens)


def _expand(rows: DataFrame, width: int) -> DataFrame:
    """(fp, low, k1, k2) to the variants of the next level; k1 and k2 together name the variant and those above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, low, k1, k2 = (np.asarray(c) for c in batch.columns)
            for at in range(0, len(fp), 2048):
                part = slice(at, at + 2048)
                row, key, low_next = variants(fp[part], low[part], width)
                # 38 bits at the first level, then 21, then 12: the latter two share k2
                first, second = (key, k2[part][row]) if width == 32 else (k1[part][row], k2[part][row] << 13 | key)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (fp[part][row], low_next, first, second)], names=["fp", "low", "k1", "k2"])

    return rows.mapInArrow(run, "fp long, low long, k1 long, k2 long")


def group_links(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(members, first members) of each set of two or more that links of at most MAX_BITS bits hold together.

    A search that visits each fingerprint once; pairs are never listed.
    """
    members, firsts, left = [], [], fp
    while len(left) > 1:
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= MAX_BITS
            if near.any():
                found, left = left[near], left[~near]
                queue += list(found)
                members.append(found)
                firsts.append(np.full(len(found), first))
    return members, firsts


def _compare(rows: DataFrame, last: bool) -> DataFrame:
    """Links (fp, other, null, null, null), and the rows of variants too large to compare (fp, null, low, k1, k2).

    Rows come sorted by k1, k2. At most GROUP rows of a variant are held from one batch to the next.
    """
    names = ["fp", "other", "low", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)
        over = None  # the variant whose rows pass through
        for batch in chain(batches, [None]):
            data = held if batch is None else np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns], axis=1)])
            held = data[:0]
            if not len(data):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (data[1:, 2:] != data[:-1, 2:]).any(axis=1)]))
            sizes = np.diff(np.append(starts, len(data)))
            u = np.ascontiguousarray(data[:, 0]).view(np.uint64)
            rest = tuple(data[0, 2:]) == over  # of a variant too large to compare, however few rows are left of it
            twos = starts[:-1][sizes[:-1] == 2]
            twos = twos[twos > 0] if rest else twos
            twos = twos[np.bitwise_count(u[twos] ^ u[twos + 1]) <= MAX_BITS]
            members, firsts, hot = [u[twos + 1]], [u[twos]], []
            for k in np.unique([*np.flatnonzero(sizes > 2), *([0] if rest else []), len(sizes) - 1]):
                part = slice(starts[k], starts[k] + sizes[k])
                key = tuple(data[starts[k], 2:])
                if key == over or (sizes[k] > GROUP and not last):
                    hot.append(data[part])
                    over = key
                elif k == len(sizes) - 1 and batch is not None:
                    held = data[part].copy()
                else:
                    found = group_links(u[part])
                    members += found[0]
                    firsts += found[1]
            a, b = np.concatenate(members).view(np.int64), np.concatenate(firsts).view(np.int64)
            over_rows = np.concatenate([*hot, data[:0]])
            null = [None] * len(a)
            columns = [np.concatenate([a, over_rows[:, 0]]), [*b.tolist(), *[None] * len(over_rows)], *([*null, *over_rows[:, k].tolist()] for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.mapInArrow(run, "fp long, other long, low long, k1 long, k2 long")


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (fp, other) that hold together all fingerprints within MAX_BITS bits; distinct has one column, fp."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    parts = []
    for width in (32, 16, 8):
        tasks = max(1, min(MOST_TASKS, -(-rows.count() // EXPANDED)))  # a number, as few bytes become many variants
        shared = _expand(rows.repartition(tasks, "fp", "k1", "k2"), width).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
        found = cut(_compare(shared, last=width == 8))
        parts.append(found.filter(F.col("other").isNotNull()).select("fp", "other"))
        rows = found.filter(F.col("other").isNull()).select("fp", "low", "k1", "k2")
        if width == 8 or rows.isEmpty():
            break
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.distinct()


def roots(marked: DataFrame) -> DataFrame:
    """(fp, _root) for every fingerprint of marked; those that links reach share a root."""
    distinct = marked.select("fp").distinct()
    member = connected_components(near_links(distinct), "fp", "other")
    return distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", F.coalesce("component", "fp").alias("_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp, component_id), one row per document; component_id is the least id that links reach."""
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    marked = cut(fingerprints(plain, "id", "text", shingle))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("_least"))
    named = distinct.join(roots(marked), "fp")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return marked.join(named.join(least, "_root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def first_of_each(marked: DataFrame) -> DataFrame:
    """(CONTENT) of one row of each group of (order, CONTENT, fp): the first by order."""
    least = marked.groupBy("fp").agg(F.min(F.struct("order", *CONTENT)).alias("_first"))
    return least.join(roots(marked), "fp").groupBy("_root").agg(F.min("_first").alias("_first")).select(*(F.col(f"_first.{c}") for c in CONTENT))


def order_of(name: Column) -> Column:
    """By id, nulls last; then by the hash of the text."""
    return F.struct(name.isNull().alias("unnamed"), name.alias("id"), F.col("_h1").alias("hash")).alias("order")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each group, unchanged: that with the least id, nulls last, and of those the least hash of the text.

    Rows that repeat an id are rows of their own, but for those equal in every column.
    """
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no column's name clashes with ours
    named = by_content(docs.toDF(*plain.values()), plain[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(words_of(x.as_py() or ""), shingle) for x in batch.column(4)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found.view(np.int64))], names=[*batch.schema.names[:4], "fp"])

    source = named.select(order_of(F.col(plain[id_col])), *CONTENT, F.col(plain[text_col]).alias("text"))
    marked = cut(source.mapInArrow(run, T.StructType([*source.schema.fields[:4], T.StructField("fp", T.LongType())])))
    return one_of_each(named, first_of_each(marked)).select(*plain.values()).toDF(*docs.columns)
