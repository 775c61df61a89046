r"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Sources, in code point order with null last, weigh 1, 2, 3 in turn and share the total
size by weight; no target exceeds ``max_repeats`` times its source, and what that leaves over is shared
again by weight. Targets are met in blocks of ``block`` words, fewer where the least target is under 32 such blocks. Each source is dealt to shards of about
``shard_words`` words by a seeded hash of id and text, and the blocks of the whole mix go to (source, shard) units by
highest quotients v / (2k - 1), where v is the unit's part of its source's target: integer quotas. Within a
unit, documents stand in a seeded order; the quota is that many rounds through the unit's blocks plus a run
of blocks from a seeded start. So reruns agree, and no document is taken more than ``max_repeats`` times.

A hot source only has more shards. Nothing but sums per multiplier reaches the driver.

Edge cases: a null or empty text has size 0 and takes 0; sources whose documents are all empty have target
0; an empty table gives an empty result; repeated ids are documents of their own; a null id is a value; a null source is one,
the last; texts of any length are cut at words; rows alike in id and text are interchangeable and stand in one shard.
Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut, few, hashable, quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block and, about, of a shard; times that a document may be taken; the seed of all orders.
BLOCK, SHARD_WORDS, MAX_REPEATS, SEED = 64, 1_000_000, 3, 17


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source.

    Sharing what is above the limit again and again ends where every source has min(limit, level * weight)
    for one level; sources ordered by limit / weight show which are at their limit. The windows run over
    one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("_limit", (F.col("source_size") * max_repeats).cast("long"))
    ranked = (
        ranked.withColumn("_free", F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_place", F.row_number().over(by_limit))
        .withColumn("_open", F.col("_free") * F.col("weight") / F.col("_weights") <= F.col("_limit"))
    )
    first = F.min(F.when(F.col("_open"), F.struct("_place", "_free", "_weights"))).over(every)
    level = F.col("_first._free") * F.col("weight") / F.col("_first._weights")
    return ranked.withColumn("_first", first).select(
        "source", "source_size", "weight", F.when(F.col("_place") < F.col("_first._place"), F.col("_limit").cast("double")).otherwise(level).alias("target")
    )


def apportion(units: DataFrame, seats: int, votes: str = "votes", limit: str = "limit", order: tuple[str, ...] = ("source", "shard")) -> DataFrame:
    """Adds quota to each row: the seats it gets when all go by highest quotients votes / (2k - 1), limit rows at most.

    The multiplier is bracketed by aggregates of many candidates at once; only seats between the two ends of
    the bracket are then ranked. Ties go by the columns of order, nulls last. units must be cheap to read again.
    """

    def at(theta: float) -> Column:
        return F.least(F.col(limit), F.floor((F.col(votes) / F.lit(float(theta)) + 1) / 2)).cast("long")

    if seats <= 0 or not (top := units.agg(F.max(votes)).first()[0]):
        return units.withColumn("quota", F.lit(0).cast("long"))
    high, low, steps = top * 1.01, None, 48
    while low is None:
        low = high / 2
        if units.agg(F.sum(at(low))).first()[0] < seats:
            high, low = low, None
    # sums(high) < seats <= sums(low)
    for _ in range(3):
        grid = [low + (high - low) * i / steps for i in range(1, steps)]
        sums = units.agg(*(F.sum(at(x)).alias(f"s{i}") for i, x in enumerate(grid))).first()
        enough = [i for i, s in enumerate(sums) if s >= seats]
        low, high = (grid[enough[-1]] if enough else low), (grid[enough[-1] + 1] if enough and enough[-1] + 1 < len(grid) else high if enough else grid[0])
    base = units.agg(F.sum(at(high))).first()[0]
    extra = units.withColumn("_k", F.explode(F.when(at(low) > at(high), F.sequence(at(high) + 1, at(low)))))
    rank = F.row_number().over(Window.orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), *(F.col(c).asc_nulls_last() for c in order), "_k"))
    won = extra.withColumn("_rank", rank).filter(F.col("_rank") <= seats - base).groupBy(*(F.col(c).alias(f"_{c}") for c in order)).agg(F.count("*").alias("_more"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    return units.join(won, match, "left").select(*units.columns, (at(high) + F.coalesce(F.col("_more"), F.lit(0))).alias("quota"))


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shard_words: int, max_repeats: int, seed: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, whole (times taken whole), two part ranges of words, and the columns carried.

    What is planned reads ids, sources, sizes and hashes alone; columns carried are read anew and go through one shuffle, to their shards.
    """
    text = F.col(quoted(text_col))
    light = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("hash"), *carried)
    sized = cut(light.drop(*carried))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats)
    sources = cut(sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    # a source that gets words gets 32 blocks at least, so that rounding moves it little
    least = sources.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((least or 0) // 32)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    known = few(sources.withColumnRenamed("source", "_source"))

    def dealt(rows: DataFrame) -> DataFrame:
        joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
        return joined.select("number", F.pmod(F.xxhash64("id", "hash", F.lit(seed)), shards).alias("shard"), *rows.columns, "source_size", "target")

    units = dealt(sized).groupBy("number", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("unit_size"), F.max(F.struct("source_size", "target")).alias("s")).filter("unit_size > 0")
    units = cut(units.select("source", "number", "shard", "unit_size", (F.col("s.target") * F.col("unit_size") / F.col("s.source_size")).alias("votes"), F.ceil(F.col("unit_size") * max_repeats / block).alias("limit")))
    total = units.agg(F.sum("unit_size")).first()[0] or 0
    quotas = apportion(units, round(total / block), order=("number", "shard"))
    words = F.least(F.col("quota") * block, F.col("unit_size") * max_repeats)
    blocks = F.ceil(F.col("unit_size") / block)
    quotas = few(quotas.select("number", "shard", "unit_size", words.alias("_words"), (F.pmod(F.xxhash64("source", "shard", F.lit(seed)), blocks) * block).alias("_start")))
    ties = [F.xxhash64(*hashable(light.select(*carried)))] if carried else []
    stream = Window.partitionBy("number", "shard").orderBy(F.xxhash64("id", "hash", F.lit(seed + 1)), "id", "hash", "size", *ties)
    placed = dealt(light if carried else sized).withColumn("_off", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(quotas, ["number", "shard"], "left")
    end = F.col("_off") + F.col("size")
    rest = F.col("_words") % F.col("unit_size")
    stop = F.col("_start") + rest

    def part(a: Column, b: Column) -> Column:
        first = F.greatest(a, F.col("_off"))
        return F.struct((first - F.col("_off")).alias("first"), F.greatest(F.lit(0).cast("long"), F.least(b, end) - first).alias("n"))

    none = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    filled = F.col("unit_size").isNotNull()
    return placed.select(
        "id", "source", "size", "source_size", "target",
        F.when(filled, F.floor(F.col("_words") / F.col("unit_size"))).otherwise(0).alias("whole"),
        F.when(filled, part(F.col("_start"), F.least(stop, F.col("unit_size")))).otherwise(none).alias("part1"),
        F.when(filled, part(F.lit(0).cast("long"), stop - F.col("unit_size"))).otherwise(none).alias("part2"),
        *carried,
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_words: int = SHARD_WORDS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(id_col, source, size, source_size, target, taken), one row per document; taken counts repeats."""
    plan = plan_mix(docs, id_col, text_col, source_col, block, shard_words, max_repeats, seed)
    taken = (F.col("whole") * F.col("size") + F.col("part1.n") + F.col("part2.n")).cast("long")
    return plan.select(F.col("id").alias(id_col), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options: int) -> DataFrame:
    """The mix itself, with the columns of docs: whole documents as often as they are taken whole, then their parts.

    A part holds its words joined by single spaces, and its own length in length_col. Rows are carried through the plan, so
    ids may be null or repeat; columns of types that have no hash don't order rows that are alike in the others.
    """
    settings = {"block": BLOCK, "shard_words": SHARD_WORDS, "max_repeats": MAX_REPEATS, "seed": SEED} | options
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no column's name clashes with the plan's
    text, length = F.col(plain[text_col]), plain.get(length_col)
    plan = plan_mix(docs.toDF(*plain.values()), plain[id_col], plain[text_col], plain[source_col], **settings, carried=tuple(plain.values()))
    joined = plan.filter("whole > 0 or part1.n > 0 or part2.n > 0")
    nothing = F.struct(F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("n"))
    copies = F.concat(F.array_repeat(nothing, F.col("whole").cast("int")), F.filter(F.array("part1", "part2"), lambda p: p["n"] > 0))
    each = joined.withColumn("_copy", F.explode(copies))
    words = F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), (F.col("_copy.first") + 1).cast("int"), F.col("_copy.n").cast("int"))
    each = each.withColumn("_part", F.when(F.col("_copy.n") >= 0, F.array_join(words, " ")))
    columns = {plain[text_col]: F.coalesce("_part", text)}
    if length:
        columns[length] = F.when(F.col("_part").isNotNull(), F.length("_part")).otherwise(F.col(length)).cast(docs.schema[length_col].dataType)
    return each.select(*(columns.get(c, F.col(c)).alias(c) for c in plain.values())).toDF(*docs.columns)
