"""The run registry: one row per run, one per scored fold, and comparisons between runs.

A run is a method under a config with the code that made it; its id is made of these three. Fold scores
that are to be registered carry ATTRIBUTES, see with_run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, suite_of, unpooled
from . import scoring

STRESS = "moving_average_28"
IDENTITY = ("method", "config_json", "code_digest")
#: Columns of the two tables, in the order of the relational schema.
RUN = (
    "run_id string, method string, kind string, suite string, item_ids string, store_ids string, pool_by string, fold_step int, n_folds int, horizon int, seed int, config_json string, "
    "code_digest string, code_current int, git_branch string, git_commit string, git_dirty int, recorded_at timestamp, source string, run_seconds double, note string, "
    "n_scored int, n_unscored int, n_fallback int, rmsse_mean double, rmsse_median double, rmsse_normal double, rmsse_holiday double, bias_mean double, "
    "win_vs_ref double, impr_mean double, impr_q1 double, impr_median double, impr_q3 double, win_vs_stress double, impr_median_stress double, cache_file string"
)
FOLD_SCORE = (
    "run_id string, id string, item_id string, store_id string, fold int, origin date, week_kind string, "
    "rmsse double, bias double, mae double, rmse double, mean_actual double, n_days int, unscored boolean, fallback boolean"
)
ATTRIBUTES = ("method", "kind", "suite", "item_ids", "store_ids", "pool_by", "fold_step", "n_folds", "horizon", "seed", "config_json", "layout_json", "code_digest", "recorded_at")
#: What must agree for two runs to be matched.
MATCH = ("method", "item_ids", "store_ids", "pool_by", "fold_step", "n_folds")
#: Short names of methods in tables.
SHORT = {
    "xgboost": "XGB", "xgboost_rel": "XGB·R", "arima": "ARIMA", "ets": "ETS", "moving_average_28": "MA28", "seasonal_naive": "SN7", "seasonal_naive_364": "SN364", "mean": "MEAN", "naive": "NAIVE", "drift": "DRIFT",
}


def config_json(cfg: Config) -> str:
    """The config as one text, the same for equal configs."""
    return json.dumps(cfg.fields(), sort_keys=True)


def run_id() -> Column:
    """The method and the first 12 hex digits of the SHA-1 of what identifies the run."""
    return F.concat_ws("-", "method", F.substring(F.sha1(F.concat_ws("|", *IDENTITY).cast("binary")), 1, 12))


def with_run(scores: DataFrame, cfg: Config, code: str | Column, recorded_at: object) -> DataFrame:
    """Fold scores with what identifies and describes their run; layout_json is the config of its benchmarks, which never pool."""
    told = {
        "suite": suite_of(cfg), "item_ids": ",".join(cfg.item_ids), "store_ids": ",".join(cfg.store_ids), "pool_by": cfg.pool_by, "fold_step": cfg.fold_step, "n_folds": cfg.n_folds, "horizon": cfg.horizon,
        "seed": cfg.seed, "config_json": config_json(cfg), "layout_json": config_json(unpooled(cfg)), "code_digest": code, "recorded_at": recorded_at,
    }
    texts = {"suite", "pool_by"}
    return scores.withColumns({k: F.lit(v).cast("string") if k in texts else F.lit(v) for k, v in told.items()}).withColumn("run_id", run_id())


def run_rows(scores: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per run: attributes, counts, and headline figures against both benchmarks.

    bench has the benchmarks' scores, one per (layout_json, id, fold, method); a benchmark is not compared with itself.
    """
    rows = scoring.summarise(scores, ("run_id", *ATTRIBUTES)).withColumnRenamed("n_folds", "_scored").withColumnRenamed("_n_folds", "n_folds")
    own = scores.filter("rmsse is not null").select("run_id", "method", "layout_json", "id", "fold", F.col("rmsse").alias("m"))
    ref = bench.filter(F.col("method").isin(scoring.REFERENCE, STRESS) & F.col("rmsse").isNotNull()).select("layout_json", "id", "fold", F.col("method").alias("other"), F.col("rmsse").alias("b"))
    duels = own.join(ref, ["layout_json", "id", "fold"]).filter("method <> other").withColumn("gain", scoring.gain())
    gains = duels.groupBy("run_id", "other").agg(*scoring.gain_columns())
    of = {o: F.max(F.when(F.col("other") == o, F.struct("win_rate", "gain_mean", "gain_q1", "gain_median", "gain_q3"))) for o in (scoring.REFERENCE, STRESS)}
    wide = gains.groupBy(F.col("run_id").alias("_run")).agg(of[scoring.REFERENCE].alias("r"), of[STRESS].alias("s"))
    joined = rows.join(wide, F.col("run_id") == F.col("_run"), "left")
    return joined.select(
        "run_id", *ATTRIBUTES, F.col("_scored").alias("n_scored"), "n_valid", "n_unscored", "n_fallback", "rmsse_mean", "rmsse_median", "rmsse_normal", "rmsse_holiday", "bias_mean",
        F.col("r.win_rate").alias("win_vs_ref"), F.col("r.gain_mean").alias("impr_mean"), F.col("r.gain_q1").alias("impr_q1"), F.col("r.gain_median").alias("impr_median"), F.col("r.gain_q3").alias("impr_q3"),
        F.col("s.win_rate").alias("win_vs_stress"), F.col("s.gain_median").alias("impr_median_stress"),
    )


def fold_score_rows(scores: DataFrame) -> DataFrame:
    """The columns of FOLD_SCORE; infinite values become null."""
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("rmse", "mae", "bias", "rmsse")}
    return scores.withColumns(finite).select("run_id", "id", "item_id", "store_id", "fold", "origin", "week_kind", "rmsse", "bias", "mae", "rmse", "mean_actual", "n_days", "unscored", "fallback")


def new_runs(recorded: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming runs not on record; a recorded run keeps its first row."""
    first = Window.partitionBy("run_id").orderBy("recorded_at")
    fresh = incoming.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(recorded.select("run_id"), "run_id", "left_anti")


def add_notes(recorded: DataFrame, incoming: DataFrame) -> DataFrame:
    """The recorded runs with the notes of repeated recordings appended after their own."""
    more = incoming.filter("note <> ''").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("note")), " | ").alias("_note"))
    joined = recorded.join(more, "run_id", "left")
    note = F.nullif(F.concat_ws(" | ", F.nullif(F.col("note"), F.lit("")), "_note"), F.lit(""))
    return joined.withColumn("note", note).drop("_note")


def refreshed(recorded: DataFrame, digests: dict[str, str]) -> DataFrame:
    """The recorded runs with code_current set anew: 1 where the method's code has the run's digest now; an unknown method has none."""
    now = F.coalesce(*(F.when(F.col("method") == m, F.lit(d)) for m, d in digests.items()), F.lit(None).cast("string"))
    return recorded.withColumn("code_current", F.coalesce((F.col("code_digest") == now).cast("int"), F.lit(0)))


def runs(registry: DataFrame, where: str | None = None, params: dict | None = None) -> DataFrame:
    """Recorded runs by time, filtered by a SQL condition with named parameters."""
    return registry.sparkSession.sql(f"SELECT * FROM {{r}} WHERE {where or 'true'} ORDER BY recorded_at", args=params, r=registry)


def predecessors(registry: DataFrame) -> DataFrame:
    """(run_id, method, config_json, recorded_at, predecessor): the latest run of the same method and config that is strictly earlier, or null."""
    earlier = Window.partitionBy("method", "config_json").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    rows = registry.select("run_id", "method", "config_json", "recorded_at", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("_at"))
    return rows.withColumn("predecessor", F.max(F.struct("_at", "run_id")).over(earlier)["run_id"]).drop("_at")


def matched(new: DataFrame, old: DataFrame) -> DataFrame:
    """(run_id, before): each new run with the latest old one that agrees on MATCH, missing values being equal; null if there is none."""
    same = [F.coalesce(F.col(f"n.{c}").cast("string"), F.lit("")) == F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")) for c in MATCH]
    both = new.alias("n").join(old.alias("o"), [*same, F.col("n.run_id") != F.col("o.run_id")], "left")
    return both.groupBy(F.col("n.run_id").alias("run_id")).agg(F.max(F.struct("o.recorded_at", "o.run_id"))["run_id"].alias("before"))


def compare_runs(folds: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (run_a, run_b): paired folds, win rate of b, means, and the gain of b over a in percent."""
    a = folds.filter("rmsse is not null").select(F.col("run_id").alias("run_a"), "id", "origin", F.col("rmsse").alias("b"), F.col("bias").alias("bias_a"))
    b = folds.filter("rmsse is not null").select(F.col("run_id").alias("run_b"), "id", "origin", F.col("rmsse").alias("m"), F.col("bias").alias("bias_b"))
    rows = pairs.join(a, "run_a").join(b, ["run_b", "id", "origin"]).withColumn("gain", scoring.gain())
    q = F.percentile("gain", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("run_a", "run_b").agg(
        F.count("*").alias("n_paired"), F.count_if(F.col("b") <= 0).alias("n_undefined"), F.avg((F.col("m") < F.col("b")).cast("double")).alias("win_rate_b"), F.avg("b").alias("rmsse_a"), F.avg("m").alias("rmsse_b"),
        F.avg("bias_a").alias("bias_a"), F.avg("bias_b").alias("bias_b"), F.avg("gain").alias("gain_mean"), q[0].alias("gain_q1"), q[1].alias("gain_median"), q[2].alias("gain_q3"),
    ).withColumn("verdict", verdict())


def verdict() -> Column:
    """IDENTICAL if both quartiles are zero and the means agree, ok if the difference looks like noise, else CHECK."""
    same = (F.col("gain_q1") == 0) & (F.col("gain_q3") == 0) & (F.abs(F.col("rmsse_a") - F.col("rmsse_b")) < 1e-12)
    return F.when(same, "IDENTICAL").when((F.abs("gain_median") < 2) & F.col("win_rate_b").between(0.35, 0.65), "ok").otherwise("CHECK")


def format_comparison(row: dict) -> str:
    """One row of compare_runs as a line of text."""
    return (
        f"{row['run_b']} against {row['run_a']}: {row['n_paired']} folds, wins {row['win_rate_b']:.1%}, gain median {row['gain_median']:+.2f} % "
        f"(quartiles {row['gain_q1']:+.2f} to {row['gain_q3']:+.2f}, mean {row['gain_mean']:+.2f}), RMSSE {row['rmsse_a']:.4f} -> {row['rmsse_b']:.4f}, bias {row['bias_a']:+.3f} -> {row['bias_b']:+.3f}: {row['verdict']}"
    )


def latest(registry: DataFrame) -> DataFrame:
    """The latest run of each suite, method and pool."""
    w = Window.partitionBy("suite", "method", "pool_by").orderBy(F.desc("recorded_at"), "run_id")
    return registry.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def same_config(a: Column, b: Column) -> Column:
    """Whether two configs as JSON agree on every field that both have."""
    x, y = (F.from_json(c, "map<string,string>") for c in (a, b))
    return F.forall(F.array_intersect(F.map_keys(x), F.map_keys(y)), lambda k: F.try_element_at(x, k).eqNullSafe(F.try_element_at(y, k)))


def label() -> Column:
    """A run's name in tables: the short name of its method, and whether it is pooled."""
    short = F.coalesce(*(F.when(F.col("method") == m, F.lit(s)) for m, s in SHORT.items()), F.col("method"))
    return F.concat(short, F.when(F.col("pool_by").isNotNull(), "·P").otherwise(""))


def labelled(folds: DataFrame, current: DataFrame) -> DataFrame:
    """Fold scores of the runs in current, with their labels and suites."""
    return folds.join(current.select("run_id", label().alias("label"), "suite", "item_ids"), "run_id")


def progression(registry: DataFrame, stages: list[tuple[str, str, str | None]], metric: str) -> DataFrame:
    """(suite, item_ids, place, stage, value): one figure of the run at each stage, a (name, method, pool) each."""
    out = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("stage"), F.lit(m).alias("method"), F.lit(p).cast("string").alias("pool_by")) for k, (n, m, p) in enumerate(stages)))
    rows = registry.withColumn("_s", F.explode(out)).filter((F.col("_s.method") == F.col("method")) & F.col("_s.pool_by").eqNullSafe(F.col("pool_by")))
    return rows.select("suite", "item_ids", F.col("_s.place").alias("place"), F.col("_s.stage").alias("stage"), F.col(metric).alias("value"))


def minutes(registry: DataFrame) -> DataFrame:
    """(suite, item_ids, pool_by, minutes): time spent in runs."""
    return registry.groupBy("suite", "item_ids", "pool_by").agg((F.sum("run_seconds") / 60).alias("minutes"))


TOP3 = """
SELECT suite, method, rmsse_mean, place FROM (
  SELECT suite, method, rmsse_mean, ROW_NUMBER() OVER (PARTITION BY suite, code_digest ORDER BY rmsse_mean, method) AS place, code_digest FROM {runs}
) WHERE place <= 3 AND code_digest = :code
"""
BY_STORE = """
SELECT r.suite, r.method, f.store_id, AVG(f.rmsse) AS rmsse, COUNT(*) AS n
FROM {folds} f JOIN {runs} r ON f.run_id = r.run_id WHERE r.code_digest = :code GROUP BY r.suite, r.method, f.store_id
"""
HOLIDAY_SPLIT = """
SELECT r.suite, r.method, AVG(CASE WHEN f.week_kind = 'holiday' THEN f.rmsse END) AS holiday, AVG(CASE WHEN f.week_kind = 'normal' THEN f.rmsse END) AS normal
FROM {folds} f JOIN {runs} r ON f.run_id = r.run_id WHERE r.code_digest = :code GROUP BY r.suite, r.method
"""
