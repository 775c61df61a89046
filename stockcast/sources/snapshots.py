"""Small tables that change as one: snapshots in folders of their own, and numbered commit files that say which of them hold.

A writer reads the last commit, writes its tables beside those that hold, and then claims the next number with a file that
names them all. A number can be claimed once, in one step: by a link on a local file system, by a rename that fails if the
name is taken on others. So a writer that dies leaves the tables as they were, and one that comes second tries again from what
the first has left. Nothing that holds is ever changed or deleted.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: Tries of a commit; folders of one table beyond which they are written together.
TRIES, MOST_FOLDERS = 20, 64

Frames = dict[str, DataFrame]


class Conflict(RuntimeError):
    """Others were first at every try."""


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[int]:
    p, fs = _path(spark, f"{root}/commit")
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def _manifest(spark: SparkSession, root: str, number: int) -> dict[str, list[str]]:
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/commit/{number:010d}.json", wholetext=True).collect()))


def _claim(spark: SparkSession, root: str, number: int, manifest: Mapping[str, list[str]]) -> bool:
    """Whether the number was free and is ours now."""
    name, own = f"{root}/commit/{number:010d}.json", f"{root}/commit/.{uuid.uuid4().hex}"
    p, fs = _path(spark, own)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    target = _path(spark, name)[0]
    try:
        if fs.getUri().getScheme() != "file":
            return bool(not fs.exists(target) and fs.rename(p, target))
        os.link(fs.makeQualified(p).toUri().getPath(), fs.makeQualified(target).toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(p, False)


def read(spark: SparkSession, root: str, schemas: Mapping[str, str]) -> tuple[int, dict[str, list[str]], Frames]:
    """(number of the last commit, 0 if none; folders by table; the tables), empty ones where nothing holds yet."""
    numbers = _commits(spark, root)
    manifest = _manifest(spark, root, numbers[-1]) if numbers else {}
    folders = {t: [f"{root}/{f}" for f in manifest.get(t, [])] for t in schemas}
    return (numbers[-1] if numbers else 0), manifest, {t: spark.read.schema(s).parquet(*folders[t]) if folders[t] else spark.createDataFrame([], s) for t, s in schemas.items()}


def commit(spark: SparkSession, root: str, schemas: Mapping[str, str], change: Callable[[Frames], tuple[Frames, Frames, object]], after_write: Callable[[], None] | None = None) -> object:
    """Applies change to the tables until no other writer comes between; returns what change says.

    change gives (tables to replace, rows to add to tables, a result); with neither, nothing is committed. after_write is
    called between writing and claiming, for tests.
    """
    for _ in range(TRIES):
        number, manifest, held = read(spark, root, schemas)
        replaced, added, result = change(held)
        if not replaced and not added:
            return result
        new = {t: list(f) for t, f in manifest.items()}
        written = []
        for t, df in [*replaced.items(), *added.items()]:
            folder = f"data/{t}-{uuid.uuid4().hex}"
            more = t in added and len(new.get(t, [])) < MOST_FOLDERS
            (df if t in replaced or more else held[t].unionByName(df)).write.parquet(f"{root}/{folder}")
            new[t] = [*new.get(t, []), folder] if more else [folder]
            written.append(folder)
        if after_write:
            after_write()
        if _claim(spark, root, number + 1, new):
            return result
        for folder in written:
            p, fs = _path(spark, f"{root}/{folder}")
            fs.delete(p, True)
    raise Conflict(f"{root}: {TRIES} tries, each time another writer was first")
