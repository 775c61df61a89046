"""The registered queries of the engine's own operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, suite_config
from ..operators import asof, calendar, explore, features, fit, folds, intermittent, order, panel, registry, scoring, sketches
from ..sources import files, retail
from ..streaming import hourly

WEEKLY, DEV, TWO_YEAR = suite_config("weekly"), Config(n_folds=8), suite_config("two_year")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Benchmarks that stand in for a fitted method's levels.
STAND_INS = {"naive": 0.3, "seasonal_naive": 0.5, "mean": 0.7, "drift": 0.9}
LADDER = ("mean", "naive", "seasonal_naive", "moving_average_28")
FEATURES_SHOWN = ("lag_1", "lag_28", "roll_mean_28", "roll_std_56", "trend_7_56", "dow_mean_4", "dow_mean_8", "dow", "snap", "is_event", "days_to_holiday")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: panel.rounded(f(spark, sf_dir))
    return f


class Data:
    """A panel with its last day, predictions and scores."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "dense", cfg: Config = WEEKLY, **options: bool):
        self.spark, self.sf_dir, self.kind, self.cfg = spark, sf_dir, kind, cfg
        self.options = options

    @property
    def span(self) -> tuple[date, date]:
        if not hasattr(self, "_span"):
            self._span = retail.date_span(self.spark, self.sf_dir)
        return self._span

    @property
    def last(self) -> date:
        return self.span[1]

    @property
    def holdout(self) -> date:
        return self.cfg.holdout_start(self.last)

    def panel(self) -> DataFrame:
        return panel.load_panel(self.spark, self.sf_dir, self.kind, span=self.span, **self.options)

    def predictions(self, methods: tuple[str, ...] = folds.BENCHMARKS) -> DataFrame:
        return folds.walk_forward(self.panel(), self.cfg, self.last, methods)

    def scores(self, methods: tuple[str, ...] = folds.BENCHMARKS) -> DataFrame:
        return scoring.score_folds(self.predictions(methods))

    def weekly(self) -> DataFrame:
        return order.weekly_totals(self.predictions())

    @property
    def scored_from(self) -> date:
        """The first scored origin: half of the folds calibrate."""
        return self.cfg.origins(self.last)[self.cfg.n_folds // 2]


PANEL_COLUMNS = ("id", "item_id", "store_id", "state_id", "date", "sales", "is_filled", "event_name_1", "event_name_2", "is_holiday", "days_to_holiday", "days_since_holiday", "closure", "snap")


@query
def panel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).panel().select(*PANEL_COLUMNS)


@query
def panel_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir, "sparse").panel().select(*PANEL_COLUMNS)


@query
def panel_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir, "mid").panel().select(*PANEL_COLUMNS)


@query
def panel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.profile(Data(spark, sf_dir, "sparse").panel())


@query
def grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.grid_gaps(retail.daily_sales(retail.lines(spark, sf_dir, "sparse")))


@query
def unpivot_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines, folded to one column per month of the year and unfolded again."""
    rows = retail.lines(spark, sf_dir, "dense").withColumn("year", F.year("date"))
    wide = rows.groupBy("id", "store_id", "year").agg(*(F.sum(F.when(F.month("date") == k, F.col("quantity"))).alias(f"d_{k}") for k in range(1, 13)))
    return panel.unpivot_sales(wide, ["id", "store_id", "year"])


@query
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).panel().withColumns(calendar.day_features()).select("id", "date", *calendar.day_features(), "snap")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = retail.date_span(spark, sf_dir)
    return calendar.holiday_distance(calendar.day_frame(spark, first, last + timedelta(days=40)))


@query
def holiday_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("date", "event_name_1", "event_name_2", "is_holiday", "days_to_holiday", "days_since_holiday", "closure")


@query
def holiday_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).filter(calendar.in_holiday_window()).select("date")


@query
def snap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir, "sparse").panel().groupBy("id", "state_id").agg(F.sum("snap").alias("snap_days"))


@query
def price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir, "sparse", price=True).panel().select("id", "date", "sell_price")


@query
def prelaunch_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Data(spark, sf_dir, "sparse", price=True).panel()
    late = rows.withColumn("sell_price", F.when(F.col("date") >= F.lit(date(1996, 1, 1)), F.col("sell_price")))
    return panel.trim_prelaunch(late).groupBy("id").agg(F.min("date").alias("first_date"), F.count("*").alias("n_days"))


@query
def closure_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).panel().filter("closure").select("id", "date", "sales")


@query
def fold_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.layout(spark, WEEKLY, retail.last_date(spark, sf_dir))


@query
def fold_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, fold, n_history, n_targets, eligible) for the two-year layout."""
    d = Data(spark, sf_dir, "sparse", TWO_YEAR)
    rows = d.panel()
    w = panel.by_series()
    n = rows.withColumns({"n_history": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n_targets": F.count("*").over(w.rowsBetween(1, TWO_YEAR.test_window)), "fold": folds.fold_of(F.col("date"), TWO_YEAR, d.last)})
    return n.filter("fold is not null").select("id", "fold", "n_history", "n_targets", ((F.col("n_history") >= TWO_YEAR.min_train_days) & (F.col("n_targets") == TWO_YEAR.test_window)).alias("eligible"))


@query
def week_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir)
    return folds.fold_targets(d.panel(), d.cfg, d.last).select("id", "fold", "week_kind").distinct()


@query
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_origin_features(Data(spark, sf_dir).panel()).select("id", "date", *(f"lag_{k}" for k in features.LAGS))


@query
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_origin_features(Data(spark, sf_dir).panel()).select("id", "date", *(f"roll_{s}_{w}" for w in features.WINDOWS for s in ("mean", "std")))


@query
def trend_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_origin_features(Data(spark, sf_dir).panel()).select("id", "date", "trend_7_56")


@query
def dow_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_weekday_means(Data(spark, sf_dir).panel()).select("id", "date", *features.WEEKDAY_FEATURES)


@query
def supervised_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.supervised(Data(spark, sf_dir).panel(), 7).select("id", "origin_date", "horizon", "target_date", "target", *FEATURES_SHOWN)


@query
def relative_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.relative_target(features.supervised(Data(spark, sf_dir).panel(), 7)).select("id", "origin_date", "horizon", "relative")


@query
def recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir)
    origin = F.lit(d.cfg.origins(d.last)[0])
    return features.recency_weight(features.trainable(features.supervised(d.panel(), 7), origin), origin).select("id", "origin_date", "horizon", "weight")


@query
def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_fit, n): training rows of the first fold, those to fit on and the tail."""
    d = Data(spark, sf_dir)
    origin = F.lit(d.cfg.origins(d.last)[0])
    rows = features.fit_and_tail(features.trainable(features.supervised(d.panel(), 7), origin), origin)
    return rows.groupBy("id", "is_fit").agg(F.count("*").alias("n"), F.max("target_date").alias("last_target"))


@query
def arima_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.regressors(Data(spark, sf_dir).panel()).select("id", "date", "x_holiday", "x_pre_holiday", "x_snap")


@query
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day among the rows that each fold's features saw, beside its first target."""
    d = Data(spark, sf_dir)
    rows = d.panel()
    targets = folds.fold_targets(rows, d.cfg, d.last).groupBy("id", "fold", "origin").agg(F.min("target_date").alias("first_target"))
    seen = rows.select("id", F.col("date").alias("origin"), F.max("date").over(panel.rows_between(max(features.WINDOWS))).alias("last_history"))
    return folds.assert_no_leakage(targets.join(seen, ["id", "origin"]).select("id", "fold", "origin", "first_target", "last_history"))


def _bench(method: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Data(spark, sf_dir).predictions((method,)).select("id", "fold", "horizon", "forecast")

    f.__name__ = f"bench_{method}".replace("moving_average_28", "ma28")
    query(f)


for _m in folds.BENCHMARKS:
    _bench(_m)


@query
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).predictions()


@query
def naive_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, "sparse")
    return folds.naive_scale(d.panel(), d.cfg, d.last)


@query
def naive_scale_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, "dense", Config(rmsse_scale_window="per_fold"))
    return folds.origin_rows(d.panel(), d.cfg, d.last).select("id", "fold", "scale")


@query
def score_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).scores()


@query
def rmsse_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rmsse_by_store(Data(spark, sf_dir).scores())


@query
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.win_rates(Data(spark, sf_dir).scores())


@query
def improvement_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.improvement_over(Data(spark, sf_dir).scores())


@query
def summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summarise(Data(spark, sf_dir).scores())


@query
def rmsse_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rmsse_by_horizon(Data(spark, sf_dir).predictions())


@query
def bias_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bias_by_store(Data(spark, sf_dir).scores())


def _stats(spark: SparkSession, sf_dir: str, kind: str = "sparse") -> DataFrame:
    d = Data(spark, sf_dir, kind)
    return explore.series_stats(d.panel(), d.holdout)


@query
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query
def demand_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "mid").groupBy("demand_class").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query
def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.class_table(_stats(spark, sf_dir, "mid"), ["A", "N", "R"])


@query
def max_zero_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.zero_runs(Data(spark, sf_dir, "sparse").panel())


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir)
    return explore.event_effects(d.panel(), d.holdout)


@query
def event_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(spark, sf_dir)


@query
def event_run_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.event_run_up(_effects(spark, sf_dir))


@query
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.outliers(Data(spark, sf_dir).panel()).select("id", "date", "sales", "center", "mad", "is_outlier")


@query
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.outlier_counts(explore.outliers(Data(spark, sf_dir, "mid").panel()))


@query
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.acf(Data(spark, sf_dir).panel(), 28)


@query
def ljung_box_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.ljung_box(explore.acf(Data(spark, sf_dir).panel(), 14))


@query
def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.profile(Data(spark, sf_dir).panel(), "dow")


@query
def month_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.profile(Data(spark, sf_dir).panel(), "month")


@query
def indexed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.indexed_profile(Data(spark, sf_dir, "sparse").panel())


@query
def snap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.snap_lift(Data(spark, sf_dir, "sparse").panel())


@query
def price_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.price_weeks(Data(spark, sf_dir, "sparse", price=True).panel())


@query
def price_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.price_spells(Data(spark, sf_dir, "dense", price=True).panel())


@query
def year_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.year_overlay(Data(spark, sf_dir).panel())


@query
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.residual_histogram(explore.residuals(Data(spark, sf_dir).predictions()))


@query
def residual_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of the seasonal benchmark's one-day residuals."""
    rows = explore.residuals(Data(spark, sf_dir).predictions(("seasonal_naive",)))
    return explore.acf(rows, 7, "residual")


@query
def monthly_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.monthly_level(Data(spark, sf_dir).predictions())


@query
def weekly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).weekly()


@query
def weekly_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.weekly_bias(Data(spark, sf_dir).weekly())


@query
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, cfg=TWO_YEAR)
    return order.calibrate(d.weekly(), d.scored_from)


@query
def calibrate_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, cfg=TWO_YEAR)
    return order.calibrate_expanding(d.weekly(), d.scored_from)


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, cfg=TWO_YEAR)
    weekly = d.weekly()
    return order.quantile_forecasts(weekly, order.calibrate(weekly, d.scored_from), d.scored_from)


@query
def quantile_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(spark, sf_dir).select("id", "method", "fold", "tau", "actual", "forecast", "q")


@query
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.score_quantiles(_quantiles(spark, sf_dir)).select("id", "method", "fold", "tau", "pinball", "pinball_rel", "covered", "shortfall", "surplus")


@query
def summarise_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.summarise_quantiles(order.score_quantiles(_quantiles(spark, sf_dir)))


@query
def ranking_by_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ranking_by_tau(order.summarise_quantiles(order.score_quantiles(_quantiles(spark, sf_dir))))


@query
def order_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.order_band(_quantiles(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, cfg=TWO_YEAR)
    return order.daily_calibrated(d.predictions(), d.scored_from, ("seasonal_naive", "moving_average_28"))


@query
def daily_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).select("id", "method", "fold", "horizon", "tau", "actual", "forecast", "q")


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.daily_native(Data(spark, sf_dir).predictions(tuple(STAND_INS)), STAND_INS, "benchmarks")


@query
def daily_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _native(spark, sf_dir).select("id", "method", "fold", "horizon", "tau", "actual", "q", "source")


@query
def daily_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = order.score_quantiles(_daily(spark, sf_dir))
    return order.ranking_by_tau(order.summarise_quantiles(scored, by=("method", "source", "tau")))


@query
def weekly_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.weekly_native(_native(spark, sf_dir)).select("id", "fold", "method", "tau", "actual", "q", "n_days")


@query
def weekly_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weekly_absolute_error(Data(spark, sf_dir).predictions(), by_store=True)


@query
def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair(Data(spark, sf_dir).scores(), "moving_average_28", "seasonal_naive")


@query
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ladder(Data(spark, sf_dir).scores(), LADDER)


@query
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matrix(Data(spark, sf_dir).scores(), folds.BENCHMARKS, ("seasonal_naive", "moving_average_28"))


@query
def scores_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, "mid")
    return scoring.scores_by_class(d.scores(), explore.series_stats(d.panel(), d.holdout))


@query
def forecast_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir)
    return scoring.forecast_difference(d.predictions(("seasonal_naive",)), d.predictions(("naive",)))


@query
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir)
    return scoring.identity_gate(d.predictions(), d.predictions().filter("fold < 50"))


#: The runs that the registry queries see. (code, day of January 2024, pooled, what happens to the errors of a fold.)
RUNS = (("c1", 1, False, "same"), ("c2", 2, False, "even folds better"), ("c2", 4, True, "all better"), ("c3", 5, False, "even folds better"), ("c4", 6, False, "two folds in five worse"))


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fold scores with their runs, benchmark scores by layout): several runs of each benchmark on the weekly layout, one on the short one.

    The walk-forward runs once per layout and is kept; the runs are made of its scores.
    """
    weekly, short = (Data(spark, sf_dir, cfg=c).scores().persist(StorageLevel.DISK_ONLY) for c in (WEEKLY, DEV))
    change = {"same": F.lit(1.0), "even folds better": F.when(F.col("fold") % 2 == 0, 0.9).otherwise(1.0), "all better": F.lit(0.95), "two folds in five worse": F.when(F.col("fold") % 5 < 2, 1.4).otherwise(1.0)}
    out = registry.with_run(short, DEV, "c1", date(2024, 1, 3))
    for code, day, pooled, what in RUNS:
        rows = weekly.withColumns({c: F.col(c) * change[what] for c in ("rmsse", "rmse")})
        out = out.unionByName(registry.with_run(rows, replace(WEEKLY, pool_by="item_id" if pooled else None), code, date(2024, 1, day)))
    bench = registry.with_run(weekly, WEEKLY, "", None).select("layout_json", "id", "fold", "method", "rmsse").unionByName(registry.with_run(short, DEV, "", None).select("layout_json", "id", "fold", "method", "rmsse"))
    return out, bench


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table, with seconds and a note."""
    rows = registry.run_rows(*_recorded(spark, sf_dir))
    return rows.withColumns({"run_seconds": F.length("method") * 10.0, "note": F.when(F.col("code_digest") != "c1", F.concat(F.lit("refit "), "code_digest"))})


@query
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_rows(*_recorded(spark, sf_dir)).drop("config_json", "layout_json")


@query
def fold_score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.fold_score_rows(_recorded(spark, sf_dir)[0])


@query
def predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.predecessors(_runs(spark, sf_dir)).drop("config_json")


@query
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _recorded(spark, sf_dir)[0]
    runs = scores.select("run_id", "method", "config_json", "recorded_at").distinct()
    pairs = registry.predecessors(runs).filter("predecessor is not null").select(F.col("predecessor").alias("run_a"), F.col("run_id").alias("run_b"))
    return registry.compare_runs(registry.fold_score_rows(scores), pairs)


@query
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs noted as a refit with the latest other run of the same method, layout and pool."""
    rows = _runs(spark, sf_dir)
    return registry.matched(rows.filter("note like 'refit c3%'"), rows)


@query
def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table after recording all runs where the first two codes are on record already: first rows stay, notes are appended."""
    rows = _runs(spark, sf_dir).select("run_id", "method", "suite", "code_digest", "recorded_at", "note")
    known, again = rows.filter("code_digest in ('c1', 'c2')"), rows.withColumns({"recorded_at": F.date_add("recorded_at", 30), "note": F.lit("again")})
    return registry.add_notes(known, again).unionByName(registry.new_runs(known, again))


@query
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached runs that are not on record, where the runs of one code were recorded: a new config or code of a known method counts as missing."""
    rows = _runs(spark, sf_dir)
    found = rows.select("run_id", "method", F.col("code_digest").alias("code"), F.col("pool_by"))
    return files.not_recorded(found, rows.filter("code_digest = 'c2' and pool_by is null"))


@query
def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.refreshed(_runs(spark, sf_dir), {"naive": "c2", "mean": "c1", "drift": "c9"}).select("run_id", "method", "code_digest", "code_current")


@query
def same_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of runs of one method whose configs agree on the fields that both have; the pooled ones have lost that field."""
    rows = _runs(spark, sf_dir).select("run_id", "method", F.when(F.col("pool_by").isNotNull(), F.regexp_replace("config_json", ', "pool_by": "[^"]*"', "")).otherwise(F.col("config_json")).alias("c"))
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.method = b.method and a.run_id < b.run_id"))
    return both.filter(registry.same_config(F.col("a.c"), F.col("b.c"))).select(F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"))


@query
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, bench = _recorded(spark, sf_dir)
    current = registry.latest(registry.run_rows(scores, bench))
    return registry.labelled(registry.fold_score_rows(scores), current).groupBy("run_id", "label", "suite").agg(F.count("*").alias("n"), F.avg("rmsse").alias("rmsse"))


@query
def stage_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [("yearly", "seasonal_naive_364", None), ("level", "moving_average_28", None), ("pooled level", "moving_average_28", "item_id")]
    return registry.progression(registry.latest(_runs(spark, sf_dir)), stages, "rmsse_mean")


@query
def run_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.minutes(_runs(spark, sf_dir))


@query
def scale_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scale_change(Data(spark, sf_dir).predictions(("naive",)), Data(spark, sf_dir, cfg=DEV).predictions(("naive",)))


@query
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.stats_summary(_stats(spark, sf_dir, "mid"))


@query
def zero_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.zero_rates(_stats(spark, sf_dir, "mid"))


@query
def worst_zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.worst_zero_runs(Data(spark, sf_dir, "sparse").panel())


@query
def tau_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.tau_lines(order.summarise_quantiles(order.score_quantiles(_quantiles(spark, sf_dir))), "seasonal_naive")


def _registry_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    scores, bench = _recorded(spark, sf_dir)
    frames = {"runs": registry.run_rows(scores, bench)} | ({"folds": registry.fold_score_rows(scores)} if "{folds}" in text else {})
    return spark.sql(text, args={"code": "c1"}, **frames)


@query
def registry_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_sql(spark, sf_dir, registry.TOP3)


@query
def registry_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_sql(spark, sf_dir, registry.BY_STORE)


@query
def registry_holiday_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_sql(spark, sf_dir, registry.HOLIDAY_SPLIT)


@query
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(_runs(spark, sf_dir)).select("suite", "method", "pool_by", "code_digest", "run_id", "recorded_at", "rmsse_mean")


def _fitted(name: str, method: str, pool: str | None = None) -> None:
    """Series methods run over the weekly layout, boosted ones over that of development with all their rounds."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        cfg = replace(WEEKLY if method in fit.SERIES_METHODS else DEV, pool_by=pool)
        d = Data(spark, sf_dir, cfg=cfg)
        rows = d.panel()
        if method in fit.SERIES_METHODS:
            made = fit.series_forecasts(rows, cfg, d.last, method, n_series=4)
        else:
            made = fit.tree_forecasts(rows, cfg, d.last, method, n_groups=4)
        return fit.predictions(rows, cfg, d.last, made)

    f.__name__ = name
    query(f)


for _name, _method, _pool in (
    ("ets", "ets", None), ("arima", "arima", None), ("arima_plain", "arima_plain", None), ("arma", "arma", None), ("gbt", "xgboost", None), ("gbt_pooled", "xgboost", "item_id"), ("gbt_rel", "xgboost_rel", None),
    ("gbt_rel_pooled", "xgboost_rel", "item_id"), ("gbt_poisson", "xgboost_poisson", None), ("gbt_rel_recent", "xgboost_rel_recent", None), ("gbt_quantiles", "xgboost_quantile", None),
):
    _fitted(_name, _method, _pool)


@query
def calibrate_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding offsets of all series of an item together, from merged sketches, which are exact at this number of errors."""
    d = Data(spark, sf_dir, "sparse")
    keys = ("item_id", "method")
    return sketches.expanding(sketches.error_sketches(d.weekly(), keys), d.scored_from, keys)


@query
def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line with its part's price on the order's date; prices hold from the date on at which they were charged."""
    sold = retail.table(spark, sf_dir, "lineitem")
    prices = sold.filter("l_quantity > 0").select("l_partkey", retail.day("l_shipdate").alias("price_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    orders = retail.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), retail.day("o_orderdate").alias("order_date"))
    lines = sold.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "order_date")
    return asof.asof_join(lines, prices, ("l_partkey",), "order_date", "price_date", ("price",), least=True, counted=sold.select("l_partkey"))


@query
def croston(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, "sparse")
    return intermittent.predictions(d.panel(), d.cfg, d.last, ("croston", "croston_sba"))


@query
def tsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, "sparse")
    return intermittent.predictions(d.panel(), d.cfg, d.last, ("tsb",))


@query
def demand_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each method alone, and of the one that each class of demand is routed to."""
    d = Data(spark, sf_dir, "sparse")
    rows = d.panel()
    made = d.predictions().unionByName(intermittent.predictions(rows, d.cfg, d.last))
    every = made.unionByName(intermittent.routed(made, explore.series_stats(rows, d.holdout)))
    return scoring.score_folds(every).groupBy("method").agg(F.count("rmsse").alias("n"), F.avg("rmsse").alias("rmsse"), F.avg("mae").alias("mae"), F.avg("bias").alias("bias"))


def _fitted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantiles of the quantile method itself, over the layout of development."""
    d = Data(spark, sf_dir, cfg=DEV)
    rows = d.panel()
    return order.daily_native(fit.predictions(rows, d.cfg, d.last, fit.tree_forecasts(rows, d.cfg, d.last, "xgboost_quantile", n_groups=4)))


@query
def daily_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_levels(spark, sf_dir).select("id", "method", "fold", "horizon", "tau", "actual", "q", "source")


@query
def weekly_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the weekly sums of fitted daily quantiles, by level."""
    return order.summarise_quantiles(order.score_quantiles(order.weekly_native(_fitted_levels(spark, sf_dir))), by=("method", "tau"))


@query
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.hourly_totals(retail.table(spark, sf_dir, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
