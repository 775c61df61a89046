"""File sources and sinks: the wide CSV inputs, cached frames with sidecars, registry tables, exports."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import subprocess
import textwrap
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..operators import calendar, features, panel, registry

#: Columns of the inputs.
SALES_IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
CALENDAR = "d string, date date, wm_yr_wk int, wday int, month int, year int, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by name: those of the schema, whatever the order in the file; others are not read."""
    wanted = T._parse_datatype_string(schema)
    names = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in wanted}
    full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    return spark.read.schema(full).option("header", True).csv(path).select(*wanted.fieldNames())


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Wide sales: ids as strings and one integer column per day."""
    names = spark.read.option("header", True).csv(path).columns
    kinds = [T.StructField(n, T.StringType() if n in SALES_IDS else T.IntegerType()) for n in names]
    return spark.read.schema(T.StructType(kinds)).option("header", True).csv(path)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CALENDAR)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, PRICES)


def panel_from_files(sales: DataFrame, days: DataFrame, prices: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The panel from the three inputs: filter, unpivot, join with checked keys, trim, impute.

    Series and column filters are placed before the unpivot, which multiplies rows by days.
    """
    wide = panel.select_series(sales, cfg) if cfg else sales
    long = panel.unpivot_sales(wide, list(SALES_IDS)).withColumn("sales", F.col("sales").cast("double"))
    days = calendar.holiday_distance(days.select("d", "date", "wm_yr_wk", "event_name_1", "event_name_2", "snap_CA", "snap_TX", "snap_WI"))
    df = calendar.snap_flag(panel.join_dimension(long, days, ["d"], small=True).drop("d"))
    df = panel.join_dimension(df, prices, ["store_id", "item_id", "wm_yr_wk"])
    return panel.impute_closures(panel.trim_prelaunch(df))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete frame is at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame at the path, built and written first if it isn't complete there; the marker file is written last."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def code_digest(*parts: object) -> str:
    """12 hex digits of the source of functions or modules, docstrings and comments left out."""
    out = []
    for part in parts:
        tree = ast.parse(textwrap.dedent(inspect.getsource(part)))
        for node in ast.walk(tree):
            if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef) and ast.get_docstring(node) is not None:
                node.body = node.body[1:] or [ast.Pass()]
        out.append(ast.dump(tree))
    return hashlib.sha1("\n".join(out).encode()).hexdigest()[:12]


def cache_name(cfg: Config, method: str, code: str) -> str:
    """The run's id, by the rule of registry.run_id."""
    text = "|".join((method, registry.config_json(cfg), code))
    return f"{method}-{hashlib.sha1(text.encode()).hexdigest()[:12]}"


def write_predictions(predictions: DataFrame, root: str, cfg: Config, method: str, code: str) -> str:
    """One method's predictions and their sidecar {method, code, config}; both must be there for a hit."""
    name = f"{root}/{cache_name(cfg, method, code)}"
    predictions.write.mode("overwrite").parquet(f"{name}/rows")
    sidecar = json.dumps({"method": method, "code": code, "config": cfg.fields()})
    predictions.sparkSession.range(1).select(F.lit(sidecar).alias("value")).coalesce(1).write.mode("overwrite").text(f"{name}/meta")
    return name


def read_predictions(spark: SparkSession, root: str, cfg: Config, method: str, code: str) -> DataFrame | None:
    name = f"{root}/{cache_name(cfg, method, code)}"
    return spark.read.parquet(f"{name}/rows") if exists(spark, f"{name}/rows") and exists(spark, f"{name}/meta") else None


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, written_at, method, code, config) of all sidecars below root; config maps field to the text of its value."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/*/meta")
    told = F.from_json(F.decode("content", "UTF-8"), "method string, code string, config map<string,string>")
    return found.select(F.element_at(F.split("path", "/"), -3).alias("run_id"), F.col("modificationTime").alias("written_at"), told.alias("m")).select("run_id", "written_at", "m.*")


def config_of(recorded: dict[str, str]) -> Config:
    """The config of a sidecar: fields it doesn't know are ignored, missing ones have their defaults."""
    known = {f.name for f in fields(Config)}
    return Config(**{k: ast.literal_eval(v) for k, v in recorded.items() if k in known})


def not_recorded(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sidecars whose run, named by their folder, is not on record."""
    return found.join(recorded.select("run_id"), "run_id", "left_anti")


def check_actuals(predictions: DataFrame, df: DataFrame) -> DataFrame:
    """Fails if a prediction's actual is missing from the panel or differs from it."""
    truth = df.select("id", F.col("date").alias("target_date"), F.col("sales").alias("_now"))
    off = predictions.join(truth, ["id", "target_date"], "left").filter(F.col("_now").isNull() | (F.abs(F.col("_now") - F.col("actual")) > 1e-8 + 1e-5 * F.abs("_now")))
    if bad := off.limit(1).collect():
        raise ValueError(f"cached actuals of {bad[0]['id']} differ from the panel at {bad[0]['target_date']}")
    return predictions


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, cast; what a relational sink needs."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema)))


def supervised_cached(spark: SparkSession, root: str, df: DataFrame, cfg: Config, code: str) -> DataFrame:
    """The supervised matrix of a panel, by series, built once per code, horizon, price use, series filter and extent of the panel."""
    extent = df.agg(F.min("date"), F.max("date"), F.count("*"), F.countDistinct("id")).first()
    name = hashlib.sha1(json.dumps([code, cfg.horizon, cfg.use_price, cfg.subset(), *map(str, extent)], default=list, sort_keys=True).encode()).hexdigest()[:12]
    path = f"{root}/supervised-{name}"
    made = features.supervised(df, cfg.horizon, cfg.use_price)
    if not exists(spark, path):
        made.repartition("id").write.mode("overwrite").partitionBy("id").parquet(path)
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)  # a stated schema: ids stay texts, and no rows are no error


def export_by(df: DataFrame, keys: tuple[str, ...], root: str) -> None:
    """One CSV folder per combination of keys, such as the runs of a suite and item."""
    df.write.mode("overwrite").option("header", True).partitionBy(*keys).csv(root)


def write_table(df: DataFrame, url: str, table: str, schema: str, properties: dict[str, str] | None = None) -> None:
    """Replaces a table of a relational database; rows go in batches of 500. Load parents before children."""
    typed(df, schema).write.format("jdbc").options(url=url, dbtable=table, batchsize="500", **(properties or {})).mode("overwrite").save()


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A small table as text: at most rows rows of an ordered summary."""
    body = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(rows).collect()]
    lines = [df.columns, ["-"] * len(df.columns), *body]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def git_state() -> tuple[str | None, str | None, int | None]:
    """(branch, commit, whether there are changes) of the working folder, or nothing without a repository."""
    changes = _git("status", "--porcelain")
    return _git("rev-parse", "--abbrev-ref", "HEAD"), _git("rev-parse", "--short", "HEAD"), None if changes is None else int(bool(changes))


def provenance(cfg: Config, methods: tuple[str, ...]) -> str:
    """Branch, commit, config and methods as text; without a repository the first two are unknown."""
    branch, commit, _ = git_state()
    return f"{branch or 'unknown'}@{commit or 'unknown'}: {cfg.describe()}; methods {', '.join(methods)}"
