"""Forecast, score and compare from the command line: python -m stockcast.run --suite dev --methods ets naive."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import recording
from .config import LAYOUTS, suite_config
from .operators import fit, folds, panel, scoring
from .sources import files, retail


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True, help="folder of the input tables")
    p.add_argument("--suite", choices=sorted(LAYOUTS), default="weekly")
    p.add_argument("--panel", choices=retail.KINDS, default="dense")
    p.add_argument("--methods", nargs="+", default=list(folds.BENCHMARKS))
    p.add_argument("--pool-by", default=None)
    p.add_argument("--item", nargs="*", default=[], help="items to keep; all, if none is given")
    p.add_argument("--store", nargs="*", default=[], help="stores to keep")
    p.add_argument("--out", help="folder for predictions")
    p.add_argument("--registry", help="folder of the run registry; runs are recorded there and compared with their predecessors")
    p.add_argument("--note", help="kept with the recorded runs")
    args = p.parse_args(argv)
    if args.registry and not args.out:
        print("--registry needs --out", file=sys.stderr)
        return 2
    cfg = suite_config(args.suite, pool_by=args.pool_by, item_ids=tuple(args.item), store_ids=tuple(args.store))
    known = {*folds.BENCHMARKS, *fit.SERIES_METHODS, *fit.TREE_METHODS}
    if unknown := [m for m in args.methods if m not in known]:
        print(f"unknown methods {unknown}; known: {', '.join(sorted(known))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    span = retail.date_span(spark, args.data)
    df = panel.load_panel(spark, args.data, args.panel, cfg=cfg, span=span)
    methods = tuple(args.methods)
    if args.registry:
        for run in recording.record(df, cfg, span[1], methods, args.registry, args.out, args.note):
            recording.main(["--registry", args.registry, "show", run])
            recording.main(["--registry", args.registry, "compare", run])
        return 0
    made = fit.run(df, cfg, span[1], methods)
    if args.out:
        made.write.mode("overwrite").partitionBy("method").parquet(args.out)
        made = spark.read.parquet(args.out)
    print(files.provenance(cfg, methods))
    print(files.markdown(scoring.summarise(scoring.score_folds(made)).orderBy(F.col("rmsse_mean").asc_nulls_last())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
