"""Fitted forecasters over walk-forward folds, as grouped pandas functions.

A group is a series (or a pool of them) and a chunk of folds, so data is copied once per chunk rather than
once per fold; inside, rows are sorted once and cut by date. Every method returns (id, fold, method,
horizon, forecast, fallback): what can't be fitted becomes the 28-day mean and says so.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..models import ets, gbt, sarima
from . import features, folds, pooled

OUT = "id string, fold long, method string, horizon int, forecast double, fallback boolean"
#: Days of history that the series models see; levels of the quantile method.
RECENT, LEVELS = 730, (0.3, 0.5, 0.7, 0.9)
REGRESSORS = ("x_holiday", "x_pre_holiday", "x_snap")
SERIES_METHODS = ("ets", "arima", "arima_plain", "arma")
#: Boosted methods: loss, whether the target is relative to the 28-day level, whether recent rows weigh more.
TREE_METHODS = {"xgboost": ("squared", False, False), "xgboost_rel": ("squared", True, False), "xgboost_poisson": ("poisson", False, False), "xgboost_rel_recent": ("squared", True, True), "xgboost_quantile": ("pinball", False, False)}
#: Calls of one group beyond which folds go to another task, in layouts long enough; rows up to which a pool is fitted in one task.
FOLDS_PER_TASK, POOL_ROWS = 4, 500_000


def _origins(cfg: Config, last: date) -> list[tuple[int, np.datetime64]]:
    return [(k, np.datetime64(o, "D")) for k, o in enumerate(cfg.origins(last))]


def _one_thread() -> None:
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ[name] = "1"


def folds_per_task(cfg: Config) -> int:
    """Short layouts are dealt fold by fold."""
    return max(1, min(FOLDS_PER_TASK, cfg.n_folds // 8))


def _chunked(df: DataFrame, cfg: Config, last: date, keys: list[str], groups: int, day: str, ahead: int) -> DataFrame:
    """Copies rows to each chunk of folds that can use them - those up to ahead days after its last origin - and deals the groups over
    tasks; the number is explicit so that small groups with much work aren't put together."""
    origins, size = cfg.origins(last), folds_per_task(cfg)
    ends = [origins[min(k + size, cfg.n_folds) - 1] for k in range(0, cfg.n_folds, size)]
    chunks = F.array(*(F.struct(F.lit(k).alias("chunk"), F.lit(e).alias("end")) for k, e in enumerate(ends)))
    copies = df.withColumn("_c", F.explode(F.filter(chunks, lambda c: F.col(day) <= F.date_add(c["end"], ahead))))
    return copies.withColumn("chunk", F.col("_c.chunk")).drop("_c").repartition(max(1, min(groups * len(ends), 2000)), *keys, "chunk")


def _rows(series: str, fold: int, method: str, values: np.ndarray, fallback: bool) -> pd.DataFrame:
    return pd.DataFrame({"id": series, "fold": fold, "method": method, "horizon": np.arange(1, len(values) + 1, dtype=np.int32), "forecast": np.asarray(values, float), "fallback": fallback})


def _usable(values: np.ndarray, y: np.ndarray) -> bool:
    return bool(np.isfinite(values).all() and np.abs(values).max() <= 10 * max(y.max(initial=0), 1))


def series_orders(panel: DataFrame, cfg: Config, last: date, method: str) -> DataFrame:
    """(id, p, q, sp, sq): the order of each series, from its history at its first scored origin.

    A series that is scored at no origin has no row; one to which no order can be fitted is an error.
    """
    seasonal = method != "arma"
    origins = F.array(*(F.lit(o) for o in cfg.origins(last)))
    ready = F.date_add(F.min("date").over(Window.partitionBy("id")), cfg.min_train_days - 1)
    cutoff = F.array_min(F.filter(origins, lambda o: o >= F.col("_ready")))
    past = features.regressors(panel).withColumn("_ready", ready).filter(F.col("date") <= cutoff).select("id", "date", "sales", *REGRESSORS)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        _one_thread()
        pdf = pdf.sort_values("date").tail(RECENT)
        x = pdf[list(REGRESSORS)].to_numpy() if method == "arima" else None
        try:
            order = sarima.select(pdf["sales"].to_numpy(), cfg.season, seasonal, x)
        except ValueError as e:
            raise RuntimeError(f"series {pdf['id'].iloc[0]}: {e}") from e
        return pd.DataFrame([(pdf["id"].iloc[0], *order)], columns=["id", "p", "q", "sp", "sq"])

    return past.groupBy("id").applyInPandas(choose, "id string, p int, q int, sp int, sq int")


def series_forecasts(panel: DataFrame, cfg: Config, last: date, method: str, n_series: int = 64) -> DataFrame:
    """Forecasts of a series method for every eligible fold."""
    if method not in SERIES_METHODS:
        raise ValueError(f"unknown series method {method!r}")
    origins, h, season = _origins(cfg, last), cfg.test_window, cfg.season
    rows = features.regressors(panel).select("id", "date", "sales", *REGRESSORS)
    if method != "ets":
        rows = rows.join(series_orders(panel, cfg, last, method), "id", "left")

    def forecast(y: np.ndarray, x: np.ndarray, ahead: np.ndarray, order: tuple | None) -> np.ndarray:
        if method == "ets":
            return ets.fit_forecast(y, h, season)
        seasonal, with_x = method != "arma", method == "arima"
        if len(y) < 4 * season:
            raise ValueError("too short")
        fit = sarima.Fit(y, order, season, seasonal, x if with_x else None)
        both = np.concatenate([x, ahead])
        return fit.forecast(h, ahead, both[len(x) - season : len(x) - season + h] if with_x else None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _one_thread()
        pdf = pdf.sort_values("date")
        days, y, x = pdf["date"].to_numpy().astype("datetime64[D]"), pdf["sales"].to_numpy(float), pdf[list(REGRESSORS)].to_numpy(float)
        order = None
        known = method != "ets" and pdf["p"].notna().all()
        if known:
            order = tuple(int(v) for v in pdf[["p", "q", "sp", "sq"]].iloc[0])
        out = []
        for k, origin in origins:
            n = int(np.searchsorted(days, origin, side="right"))
            if k // folds_per_task(cfg) != pdf["chunk"].iloc[0] or n < cfg.min_train_days or len(days) - n < h:
                continue
            if method != "ets" and not known:
                raise RuntimeError(f"series {pdf['id'].iloc[0]} is scored but has no order")
            past = slice(max(0, n - RECENT), n)
            fallback = False
            try:
                values = forecast(y[past], x[past], x[n : n + h], order)
                fallback = not _usable(values, y[past])
            except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                fallback = True
            if fallback:
                values = np.full(h, y[max(0, n - 28) : n].mean())
            out.append(_rows(pdf["id"].iloc[0], k, method, np.maximum(values, 0), fallback))
        return pd.concat(out) if out else _rows("", 0, method, np.empty(0), False)

    return _chunked(rows, cfg, last, ["id"], n_series, "date", h).groupBy("id", "chunk").applyInPandas(run, OUT)


def _with_codes(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Who a row belongs to: for each column c a column code_c, its place among the sorted names of the row's pool."""
    for c in columns:
        place = F.row_number().over(Window.partitionBy("pool").orderBy(c)) - 1
        rows = rows.join(rows.select("pool", c).distinct().withColumn(f"code_{c}", place.cast("double")), ["pool", c])
    return rows


def _pools_forecasts(rows: DataFrame, names: list[str], origins: list, settings: gbt.Settings, known: dict, method: str) -> DataFrame:
    kind, relative, recent = TREE_METHODS[method]
    made = lambda tau: pooled.Pools(rows, names, origins, settings, known, kind, tau, relative, recent).grow().predict()
    if kind != "pinball":
        return made(0.5).select("id", "fold", F.lit(method).alias("method"), "horizon", "forecast", "fallback")
    keys, parts = ["id", "fold", "horizon"], made(LEVELS[0]).withColumnRenamed("forecast", "q0")
    for k, tau in enumerate(LEVELS[1:], 1):
        parts = parts.join(made(tau).select(*keys, F.col("forecast").alias(f"q{k}")), keys)
    ordered = parts.select(*keys, "fallback", F.posexplode(F.array_sort(F.array(*(f"q{k}" for k in range(len(LEVELS)))))).alias("place", "forecast"))
    label = F.array(*(F.lit(f"xgboost_q{round(100 * t)}") for t in LEVELS))[F.col("place")]
    return ordered.select("id", "fold", label.alias("method"), "horizon", "forecast", "fallback")


def tree_forecasts(panel: DataFrame, cfg: Config, last: date, method: str, settings: gbt.Settings | None = None, n_groups: int = 64, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Forecasts of a boosted method; cfg.pool_by says which series share a fit (None: each alone).

    Pools have bins made once, of what is known at the first origin. If the largest has pool_rows rows at most, a pool is fitted in one
    task per chunk of folds; else by the sums of stockcast.operators.pooled, which give the same trees. The quantile method fits its levels in one call and returns one method per level, sorted so that levels
    don't cross.
    """
    if method not in TREE_METHODS:
        raise ValueError(f"unknown boosted method {method!r}")
    settings = settings or gbt.Settings(seed=cfg.seed)
    kind, relative, recent = TREE_METHODS[method]
    origins, h = _origins(cfg, last), cfg.test_window
    names = [*features.ORIGIN_FEATURES, *features.WEEKDAY_FEATURES, *features.TARGET_FEATURES, "horizon", *(["sell_price"] if cfg.use_price else [])]
    pool = cfg.pool_by or "id"
    # every row of history counts: origins near the end of the panel lack targets only for themselves
    rows = features.supervised(panel, cfg.horizon, cfg.use_price)
    if pool not in rows.columns:
        rows = rows.join(panel.groupBy("id").agg(F.first(pool).alias(pool)), "id")
    rows = rows.withColumn("pool", F.col(pool).cast("string")).select("pool", "id", "item_id", "store_id", "origin_date", "target_date", "target", *names, pooled.row_key("id", "origin_date", "horizon"))
    known: dict = {}
    if cfg.pool_by:
        rows = _with_codes(rows, ("store_id", "item_id"))
        names = [*names, "code_store_id", "code_item_id"]
        known = pooled.edges(rows, names, settings.bins, str(origins[0][1]))
        if (rows.groupBy("pool").count().agg(F.max("count")).first()[0] or 0) > pool_rows:
            return _pools_forecasts(rows, names, origins, settings, known, method).filter(F.col("horizon") <= h)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _one_thread()
        pdf = pdf.sort_values(["id", "origin_date", "horizon"])  # sums of doubles in one order
        target_day, origin_day = (pdf[c].to_numpy().astype("datetime64[D]") for c in ("target_date", "origin_date"))
        x, keys = pdf[names].to_numpy(float), pdf["row_key"].to_numpy(np.int64)
        binner = gbt.Binner(known[pdf["pool"].iloc[0]]) if known else None
        level = pdf["roll_mean_28"].to_numpy(float)
        y = pdf["target"].to_numpy(float) - (level if relative else 0)
        out = []
        for k, origin in origins:
            if k // folds_per_task(cfg) != pdf["chunk"].iloc[0]:
                continue
            train, ask = target_day <= origin, origin_day == origin
            if not ask.any():
                continue
            fallback = not train.any()
            if not fallback:
                is_fit = (target_day[train] <= origin - np.timedelta64(90, "D"))
                age = (origin - target_day[train]).astype(float)
                weight = np.where(is_fit, 0.5 ** (age / features.HALF_LIFE), 1.0) if recent else None
                made = [gbt.Model(gbt.Loss(kind, tau), settings, binner).fit(x[train], y[train], is_fit, weight, keys[train]).predict(x[ask]) for tau in (LEVELS if kind == "pinball" else (0.5,))]
                values = np.maximum(np.stack(made) + (level[ask] if relative else 0), 0)
                values = np.sort(values, axis=0)
            else:
                values = np.tile(level[ask], (len(LEVELS) if kind == "pinball" else 1, 1))
            labels = [f"xgboost_q{round(100 * t)}" for t in LEVELS] if kind == "pinball" else [method]
            for label, v in zip(labels, values, strict=True):
                out.append(pd.DataFrame({"id": pdf["id"][ask].to_numpy(), "fold": k, "method": label, "horizon": pdf["horizon"][ask].to_numpy(np.int32), "forecast": v, "fallback": fallback}))
        return pd.concat(out) if out else _rows("", 0, method, np.empty(0), False)

    made = _chunked(rows, cfg, last, ["pool"], n_groups, "origin_date", 0).groupBy("pool", "chunk").applyInPandas(run, OUT)
    return made.filter(F.col("horizon") <= h)


def predictions(panel: DataFrame, cfg: Config, last: date, made: DataFrame) -> DataFrame:
    """Forecasts beside actuals, in the form of walk_forward; folds that aren't eligible drop out."""
    targets = folds.fold_targets(panel, cfg, last)
    joined = targets.join(made, ["id", "fold", "horizon"])
    return joined.select(
        "id", "item_id", "store_id", "fold", "origin", "week_kind", "method", F.lit("model").alias("kind"), "horizon", "target_date", "actual", "forecast", "scale", "closure", "holiday_window", "fallback",
    )


def in_order(predictions: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Sorted by method, in the order asked for (levels of one method by name), then id, fold and horizon."""
    place = F.coalesce(*(F.when((F.col("method") == m) | F.col("method").startswith(m.replace("_quantile", "_q")) & F.lit(m.endswith("_quantile")), F.lit(k)) for k, m in enumerate(methods)))
    return predictions.orderBy(place, "method", "id", "fold", "horizon")


def run(panel: DataFrame, cfg: Config, last: date, methods: tuple[str, ...], settings: gbt.Settings | None = None) -> DataFrame:
    """Predictions of benchmarks and fitted methods together, in one long table."""
    bench = tuple(m for m in methods if m in folds.BENCHMARKS)
    parts: list[DataFrame] = [folds.walk_forward(panel, cfg, last, bench)] if bench else []
    makers: dict[str, Callable[[], DataFrame]] = {m: (lambda m=m: series_forecasts(panel, cfg, last, m)) for m in SERIES_METHODS}
    makers |= {m: (lambda m=m: tree_forecasts(panel, cfg, last, m, settings)) for m in TREE_METHODS}
    for m in methods:
        if m not in folds.BENCHMARKS:
            if m not in makers:
                raise ValueError(f"unknown method {m!r}")
            parts.append(predictions(panel, cfg, last, makers[m]()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
