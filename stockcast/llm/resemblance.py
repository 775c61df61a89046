"""Edited copies that a fingerprint's radius does not reach: Jaccard similarity of word-shingle sets.

SimHash fingerprints of two texts at similarity 0.8 differ in some ten of 64 bits, so the deletion variants of
stockcast.llm.simhash, built for three, miss most edited copies. This module is what the pipeline's
near-duplicate stage runs on the documents that stage's SimHash pass keeps.

A text's shingles are hashed to a set. BANDS keys, each of ROWS minima of the set under different hashes, bring two sets
of similarity s together with odds 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8. Whatever meets is compared exactly, by
the sets themselves, if sizes and parities allow the similarity: a set's parities are PARITIES bits, each 1 if an odd number of its
hashes fall there, and two sets differ in at least as many hashes as their parities differ in bits, so what this test turns
away cannot be alike. Fingerprints, keys, sizes and parities come from one pass over the texts.

Rows under a key are not paired with each other: every row is compared with the least row that it meets first; what is
alike becomes one component, and keys whose rows are all of one component are settled. In the others, some rows - STEP, then STEP
times as many in each round - are compared with the key's rows of other components, until every pair of different components under a
key has been compared; so no link between different components is lost. Keys of many texts that are not alike list no
pairs: the test by sizes and parities stands in the join, whose large keys adaptive execution splits.

Rows are known by their content, so texts are shuffled once and written once, to a table below the checkpoint folder, apart by
whether they share a key: the sets are made of those that do, and only those are joined again in the end.

Edge cases: texts without words (null, empty, white space) are alike to none here; fewer words than a shingle make one
shingle; null and repeated ids are rows of their own, but rows equal in every column are one; an empty table gives an empty result; texts of any length are
read whole; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import CONTENT, by_content, connected_components, cut, one_of_each, scratch_folder, settled
from .simhash import fingerprint, first_of_each, order_of, words_of

#: Keys of a text, minima in a key, and growth of the rows of a key that are compared with its others in a round.
BANDS, ROWS, STEP = 24, 6, 64
#: Bits of a set's parities; words of a shingle of the fingerprints.
PARITIES, PRINTED = 1024, 3
_PIECES, _BLOCK, _AT_ONCE = 65_536, 2048, 256
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(k), 42) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The different shingle hashes (XXH64) of the words of a text, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    found = []
    for at in range(0, len(words) - shingle + 1, _PIECES):
        block = words[at : at + _PIECES + shingle - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(shingle)), strict=False))
        found.append(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64))
    return np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set, as signed longs; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[None, at : at + _BLOCK] * _MULTIPLIERS[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits in signed longs: bit b is 1 if an odd number of the hashes are b modulo PARITIES."""
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _longs(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))


def _marks(named: DataFrame, shingle: int) -> DataFrame:
    """(order, CONTENT, fp, size, keys, parities) of (order, CONTENT, text): all that one pass over the texts gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                prints, sizes, keys, bits = [], [], [], []
                for text in part.column(4):
                    words = words_of(text.as_py() or "")
                    hashes = shingle_set(words, shingle)
                    prints.append(fingerprint(words, PRINTED))
                    sizes.append(len(hashes))
                    keys.append(band_keys(hashes))
                    bits.append(parities(hashes))
                columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _longs(keys), _longs(bits)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=[*part.schema.names[:4], "fp", "size", "keys", "parities"])

    added = T._parse_datatype_string("fp long, size long, keys array<long>, parities array<long>")
    return named.mapInArrow(run, T.StructType([*named.schema.fields[:4], *added.fields]))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, hashes) of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), _longs([shingle_set(words_of(x.as_py() or ""), shingle) for x in part.column(1)])], names=["row", "hashes"])

    return texts.mapInArrow(run, "row long, hashes array<long>")


def _near(similarity: float) -> Column:
    """Whether the sizes and parities of two rows, those of the second with an underscore, allow the similarity."""
    differ = sum((F.bit_count(F.col("parities")[k].bitwiseXOR(F.col("_parities")[k])) for k in range(PARITIES // 64)), F.lit(0))
    return differ * (1 + similarity) <= (F.col("size") + F.col("_size")) * (1 - similarity) + 1e-6


def _other(marks: DataFrame) -> DataFrame:
    return marks.select(*(F.col(c).alias(f"_{c}") for c in ("row", "size", "parities")))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those rows of pairs (u, v, ...) whose sets reach the similarity."""
    one, other = sets.select(F.col("row").alias("u"), F.col("hashes").alias("_a")), sets.select(F.col("row").alias("v"), F.col("hashes").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.join(one, "u").join(other, "v")
    return joined.filter(both / (F.size("_a") + F.size("_b") - both) >= similarity).select(*pairs.columns)


def _meetings(nodes: DataFrame) -> DataFrame:
    """(key, row, least) of the keys of two or more rows; least is the least row of the key."""
    each = nodes.select("row", F.explode("keys").alias("key"))
    keys = each.groupBy("key").agg(F.count("*").alias("_n"), F.min("row").alias("least")).filter("_n > 1")
    return each.join(keys, "key").select("key", "row", "least")


def _joined(member: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) between components, or rows that are in none yet."""
    found = connected_components(links, "u", "v").select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    moved = member.join(found, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component"))
    fresh = found.join(member, F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_component").alias("component"))
    return settled(moved.union(fresh))


def _components(nodes: DataFrame, live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the rows that links reach."""
    marks = nodes.select("row", "size", "parities")
    # every row with the least of the rows that it meets: in a group of copies, all with nearly one
    first = live.filter("row > least").groupBy("row").agg(F.min("least").alias("_row"))
    pairs = first.join(marks, "row").join(_other(marks), "_row").filter(_near(similarity)).select(F.col("row").alias("u"), F.col("_row").alias("v"))
    member = settled(connected_components(settled(_alike(pairs, sets, similarity)), "u", "v"))
    live, centres = live.select("key", "row"), STEP
    while True:
        named = live.join(member, live["row"] == member["node"], "left").select("key", "row", F.coalesce("component", "row").alias("part"))
        keys = named.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).filter("_low < _high").select("key")
        live = settled(named.join(keys, "key"))
        if live.isEmpty():
            return member
        sized = live.join(live.groupBy("key", "part").agg(F.count("*").alias("_n")), ["key", "part"])
        place = F.row_number().over(Window.partitionBy("key").orderBy("_n", "row"))
        centre = settled(sized.withColumn("place", place).filter(F.col("place") <= centres).select("key", "row", "part"))
        ends = centre.select("key", F.col("row").alias("_row"), F.col("part").alias("_part")).join(_other(marks), "_row")
        met = live.join(marks, "row").join(ends, "key").filter((F.col("part") != F.col("_part")) & _near(similarity))
        one, other = F.struct("row", "part"), F.struct(F.col("_row").alias("row"), F.col("_part").alias("part"))
        found = met.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).distinct().select(F.col("a.row").alias("u"), F.col("b.row").alias("v"), F.col("a.part").alias("pu"), F.col("b.part").alias("pv"))
        links = settled(_alike(found, sets, similarity).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        if not links.isEmpty():
            member = _joined(member, links)
        live = live.join(centre, ["key", "row"], "left_anti").select("key", "row")
        centres *= STEP


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, fingerprints: bool = False) -> DataFrame:
    """One row of each group of alike texts, unchanged: that with the least id, nulls last, and of those the least hash of the text.

    With fingerprints, first one row of each group of stockcast.llm.simhash, in the same order, and of those one of each group of
    alike ones. Rows equal in every column are one.
    """
    spark = docs.sparkSession
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no column's name clashes with ours
    named = by_content(docs.toDF(*plain.values()), plain[text_col])
    marked = cut(_marks(named.select(order_of(F.col(plain[id_col])), *CONTENT, F.col(plain[text_col]).alias("text")), shingle))
    kept = marked.dropDuplicates(list(CONTENT))
    if fingerprints:
        kept = kept.join(first_of_each(marked), list(CONTENT), "left_semi")
    nodes = cut(kept.drop("fp").withColumn("row", F.monotonically_increasing_id()))
    live = cut(_meetings(nodes))
    met = live.select("row").distinct().withColumn("_met", F.lit(True))
    folder = scratch_folder(spark)
    flagged = nodes.select(*CONTENT, "row").join(met, "row", "left").withColumn("_met", F.col("_met").isNotNull())
    one_of_each(named, flagged).select("row", "_met", *plain.values()).write.option("compression", "zstd").partitionBy("_met").parquet(folder)
    rows = spark.read.schema(T.StructType([T.StructField("row", T.LongType()), *docs.toDF(*plain.values()).schema.fields, T.StructField("_met", T.BooleanType())])).parquet(folder)
    shared = rows.filter("_met")
    sets = cut(_sets(shared.select("row", F.col(plain[text_col]).alias("text")), shingle))
    member = _components(nodes, live.select("key", "row", "least"), sets, similarity)
    ranked = member.join(nodes.select("row", "order"), F.col("node") == F.col("row"))
    stays = ranked.groupBy("component").agg(F.min(F.struct("order", "row")).alias("_first")).select("component", F.col("_first.row").alias("_stays"))
    gone = member.join(stays, "component").filter("node <> _stays").select(F.col("node").alias("row"))
    out = rows.filter(~F.col("_met")).union(shared.join(gone, "row", "left_anti").select(*rows.columns))
    return out.select(*plain.values()).toDF(*docs.columns)
