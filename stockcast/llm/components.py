"""Connected components of a link table, by alternating star operations.

Links stay in Spark: each round is two groupings and two joins on node ids, and is written to the shared
checkpoint folder, so a lost executor costs one round at most. No link reaches the driver, only a count
and a sum per round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own if the master is local, else an error."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a batch.
AT_ONCE = 512


def quoted(name: str) -> str:
    """A column name as a reference to that very column, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for frames whose columns may have any names: run sees them as c0, c1, ..., in batches of AT_ONCE rows at most.

    What a worker makes of one batch stays in its memory, so small batches keep workers small.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE))
        pa.default_memory_pool().release_unused()  # workers live on

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(sliced, schema)


#: Spark's own limit of the bytes of a batch, and what small_batches sets it to.
BATCH_BYTES, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of the bytes that an executor gathers before it hands them to a worker; a longer row goes alone.

    By default a batch is 10,000 rows, which of whole texts is all that a task reads: both sides hold it at once.
    """
    set_ = spark.conf.get(BATCH_BYTES, None)
    if not (set_ and set_.rstrip("bB").isdigit() and int(set_.rstrip("bB")) <= SMALL):
        spark.conf.set(BATCH_BYTES, str(SMALL))


#: Rows up to which a table of a few numbers a row may be broadcast.
MOST_BROADCAST = 100_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its rows, which are counted, are MOST_BROADCAST at most; else joins shuffle it."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def hashable(df: DataFrame) -> list[Column]:
    """The columns of types that have a hash."""
    return [F.col(quoted(f.name)) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


#: What names a row by its content: two hashes of the text, one of all columns. Rows alike in all three are interchangeable.
CONTENT = ("_h1", "_h2", "_h3")


def by_content(df: DataFrame, text_col: str) -> DataFrame:
    """df with the columns CONTENT, so that rows are found again without a numbered copy of their texts."""
    text = F.col(quoted(text_col))
    return df.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(17), text), "_h3": F.xxhash64(*hashable(df))})


def one_of_each(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Those rows of by_content's frame that kept names by CONTENT, one for each name; with kept's other columns.

    Rows alike go before texts are shuffled, so many of them do not meet in one task; the join finds the shuffle done.
    """
    return df.dropDuplicates(list(CONTENT)).join(kept, list(CONTENT))


#: Folders that scratch_folder has named and clear_scratch has not deleted.
_folders: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new name below the checkpoint folder, for a table that the rows returned are read from."""
    _folders.append(f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}")
    return _folders[-1]


def scratch_made() -> int:
    """How many scratch tables there are; clear_scratch takes it."""
    return len(_folders)


def clear_scratch(spark: SparkSession, since: int) -> None:
    """Deletes the scratch tables made after the first since; for a caller that has written all that was read from its own."""
    while len(_folders) > since:
        delete(spark, _folders.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job of ours has written and nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a small table that one task may read.
TASK_ROWS = 50_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def settled(df: DataFrame) -> DataFrame:
    """cut(df), read by as many tasks as its rows need, so that small tables don't make many small shuffle files."""
    df = cut(df)
    return df.coalesce(tasks_for(df.count()))


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Links each node's neighbours (the larger ones if large, else the smaller ones and itself) to its least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of a link between two different nodes; component is the least node.

    Links are undirected; repeated links, links to itself and links with a null end are allowed and add
    nothing. An empty table gives an empty table.
    """
    links = links.filter(F.col(u) != F.col(v))
    links = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before, tasks = now, tasks_for(2 * now[0])
        links = cut(_star(_star(links.coalesce(tasks), True, tasks), False, tasks))
    links = links.coalesce(tasks_for(now[0]))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
