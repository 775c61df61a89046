"""Runs on record: two tables that change as one (stockcast.sources.snapshots), filled by runs or from cached predictions, and their command line.

    python -m stockcast.recording --registry DIR list|show RUN|last|compare RUN RUN|refresh|backfill --predictions DIR
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, unpooled
from .models import ets, gbt, sarima
from .operators import features, fit, folds, registry, scoring
from .sources import files, snapshots

BENCH = (scoring.REFERENCE, registry.STRESS)


def digests() -> dict[str, str]:
    """The digest of each method's code as it is now."""
    out = {m: files.code_digest(folds.benchmark_columns, folds.walk_forward) for m in folds.BENCHMARKS}
    out |= {m: files.code_digest(features, ets if m == "ets" else sarima, fit.series_forecasts) for m in fit.SERIES_METHODS}
    return out | {m: files.code_digest(features, gbt, fit.tree_forecasts) for m in fit.TREE_METHODS}


SCHEMAS = {"run": registry.RUN, "fold_score": registry.FOLD_SCORE}


def tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, fold scores) on record; empty ones where there is nothing yet."""
    held = snapshots.read(spark, root, SCHEMAS)[2]
    return held["run"], held["fold_score"]


def insert(root: str, incoming: DataFrame, scores: DataFrame, after_write: Callable[[], None] | None = None) -> int:
    """Adds runs that are not on record with their fold scores, as one commit; of the others only new notes are kept. Returns how many are new."""
    spark = incoming.sparkSession

    def change(held: snapshots.Frames) -> tuple[snapshots.Frames, snapshots.Frames, int]:
        recorded = held["run"]
        fresh = files.typed(registry.new_runs(recorded, incoming), registry.RUN)
        n = fresh.count()
        noted = registry.add_notes(recorded, incoming.join(recorded.select("run_id"), "run_id", "left_semi"))
        rows = files.typed(registry.fold_score_rows(scores), registry.FOLD_SCORE).join(fresh.select("run_id"), "run_id", "left_semi")
        return {"run": files.typed(noted.unionByName(fresh), registry.RUN)}, {"fold_score": rows} if n else {}, n

    return snapshots.commit(spark, root, SCHEMAS, change, after_write)


def _run(predictions: DataFrame, bench: DataFrame, cfg: Config, code: str, told: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """The run row of one method's predictions, and its fold scores."""
    scores = registry.with_run(scoring.score_folds(predictions), cfg, code, told["recorded_at"])
    ref = registry.with_run(scoring.score_folds(bench), unpooled(cfg), "", told["recorded_at"])
    rows = registry.run_rows(scores, ref)
    return rows.withColumns({k: F.lit(v) for k, v in told.items()}), scores


def record(panel: DataFrame, cfg: Config, last: object, methods: tuple[str, ...], root: str, predictions: str, note: str | None = None, settings: gbt.Settings | None = None) -> list[str]:
    """Runs each method, or takes its cached predictions if they agree with the panel, and puts the run on record; returns the run ids."""
    now, ids = digests(), []
    git = dict(zip(("git_branch", "git_commit", "git_dirty"), files.git_state(), strict=True))
    bench = folds.walk_forward(panel, unpooled(cfg), last, BENCH)
    for method in methods:
        start = time.time()
        found = cached(panel, cfg, last, method, predictions, now[method], settings)
        told = {
            "code_current": 1, "recorded_at": datetime.now(timezone.utc), "source": "run", "run_seconds": round(time.time() - start, 1), "note": note, "cache_file": files.cache_name(cfg, method, now[method]), **git,
        }
        rows, scores = _run(found, bench, cfg, now[method], told)
        insert(root, rows, scores)
        ids.append(told["cache_file"])
    return ids


def cached(panel: DataFrame, cfg: Config, last: object, method: str, predictions: str, code: str, settings: gbt.Settings | None = None) -> DataFrame:
    """A method's predictions: those kept for this config and code, checked against the panel, else made and kept."""
    spark = panel.sparkSession
    found = files.read_predictions(spark, predictions, cfg, method, code)
    if found is not None:
        return files.check_actuals(found, panel)
    files.write_predictions(fit.run(panel, cfg, last, (method,), settings), predictions, cfg, method, code)
    return files.read_predictions(spark, predictions, cfg, method, code)


def refresh(spark: SparkSession, root: str, now: dict[str, str] | None = None) -> int:
    """Sets code_current of every run anew; returns how many changed."""
    now = digests() if now is None else now

    def change(held: snapshots.Frames) -> tuple[snapshots.Frames, snapshots.Frames, int]:
        new = registry.refreshed(held["run"], now)
        changed = new.select("run_id", F.col("code_current").alias("_now")).join(held["run"], "run_id").filter("not (code_current <=> _now)").count()
        return {"run": files.typed(new, registry.RUN)} if changed else {}, {}, changed

    return snapshots.commit(spark, root, SCHEMAS, change)


def backfill(panel: DataFrame, last: object, root: str, predictions: str) -> list[str]:
    """Puts every cached run below the folder on record that is not yet; its time is that of its file. Returns the new run ids."""
    spark, now = panel.sparkSession, digests()
    refresh(spark, root, now)
    missing = files.not_recorded(files.sidecars(spark, predictions), tables(spark, root)[0]).orderBy("run_id").collect()  # one small row per cached run
    out = []
    for found in missing:
        path = f"{predictions}/{found['run_id']}/rows"
        if not files.exists(spark, path):
            continue
        cfg = files.config_of(found["config"])
        bench = folds.walk_forward(panel, unpooled(cfg), last, BENCH)
        told = {"code_current": int(now.get(found["method"]) == found["code"]), "recorded_at": found["written_at"], "source": "backfill", "run_seconds": None, "note": None, "cache_file": found["run_id"]}
        told |= {"git_branch": None, "git_commit": None, "git_dirty": None}
        rows, scores = _run(spark.read.parquet(path), bench, cfg, found["code"], told)
        if insert(root, rows, scores):
            out.append(found["run_id"])
    return out


def main(argv: list[str] | None = None) -> int:
    """The command line; exit codes are 0, 1 for a run that is not on record, 2 for wrong arguments."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--registry", required=True)
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("list", "last", "refresh"):
        sub.add_parser(name)
    sub.add_parser("show").add_argument("run")
    two = sub.add_parser("compare")
    two.add_argument("run")
    two.add_argument("other", nargs="?", help="the run's predecessor, if not given")
    fill = sub.add_parser("backfill")
    for name in ("--predictions", "--data"):
        fill.add_argument(name, required=True)
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    recorded, scores = tables(spark, args.registry)
    shown = ["run_id", "suite", registry.label().alias("label"), "item_ids", "rmsse_mean", "win_vs_ref", "impr_median", "code_current", "recorded_at", "note"]
    if args.do == "list":
        print(files.markdown(registry.runs(recorded).select(*shown)))
    elif args.do == "last":
        print(files.markdown(registry.latest(recorded).select(*shown).orderBy("recorded_at")))
    elif args.do == "refresh":
        print(f"{refresh(spark, args.registry)} runs changed")
    elif args.do == "backfill":
        from .operators.panel import load_panel
        from .sources.retail import date_span

        span = date_span(spark, args.data)
        print("\n".join(backfill(load_panel(spark, args.data, span=span), span[1], args.registry, args.predictions)) or "nothing new")
    else:
        before = registry.predecessors(recorded).filter(F.col("run_id") == args.run).collect()
        if not before:
            print(f"no run {args.run}", file=sys.stderr)
            return 1
        if args.do == "show":
            row = recorded.filter(F.col("run_id") == args.run).first().asDict()
            print("\n".join(f"{k}: {v}" for k, v in row.items() if v is not None))
        else:
            other = args.other or before[0]["predecessor"]
            pairs = spark.createDataFrame([(other, args.run)], "run_a string, run_b string")
            found = registry.compare_runs(scores, pairs).collect() if other else []
            if not found:
                print(f"nothing to compare {args.run} with", file=sys.stderr)
                return 1
            print(registry.format_comparison(found[0].asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
