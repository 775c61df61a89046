"""Boosted trees for pools of any size: one job per level of the trees of all pools and folds.

Rows are cut to bins once and stay where they are, dealt by pool and row, so that a large pool is spread over tasks. A level's job sums
gradients and hessians by (pool and fold, node, bin) in each task, then over tasks; of each node's sums, at most one row a bin, the best
split is found in a grouped function. Trees, some hundred numbers each, are all that the driver holds. A row's scores, one
per fold, are written every REFRESH rounds, and in between brought up to date from the trees grown since.

What is grown equals models.gbt.Model with the same bins but for the order of sums: rows are sampled by their keys and columns by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models import gbt
from ..sources.scratch import cut

#: Rounds between writings of the scores; pools of one call at most, as their bins and trees go through the driver; accuracy of their quantiles.
REFRESH, MOST_POOLS, ACCURACY = 16, 2000, 10_000
#: Days between 1970 and a date, as dates are kept in rows.
EPOCH = np.datetime64("1970-01-01", "D")
HALF_LIFE, TAIL_DAYS = 365, 90


def edges(rows: DataFrame, names: list[str], bins: int, until: str) -> dict[str, list[np.ndarray]]:
    """The inner edges of the quantile bins of each pool's columns, from rows whose target is known by a date (all rows of a pool without any)."""
    known = F.col("target_date") <= F.lit(until)
    probabilities = np.linspace(0, 1, bins)[1:-1].tolist()
    per = [F.percentile_approx(F.when(known, F.col(c)), probabilities, ACCURACY).alias(f"k{i}") for i, c in enumerate(names)]
    per += [F.percentile_approx(F.col(c), probabilities, ACCURACY).alias(f"a{i}") for i, c in enumerate(names)]
    found = rows.groupBy("pool").agg(F.max(known).alias("known"), *per).limit(MOST_POOLS + 1).collect()
    if len(found) > MOST_POOLS:
        raise ValueError(f"more than {MOST_POOLS} pools in one call")
    return {r["pool"]: [np.unique(np.array(r[f"{'k' if r['known'] else 'a'}{i}"] or [], float)) for i in range(len(names))] for r in found}


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns).alias("row_key")


@dataclass
class _Fit:
    """One pool and fold."""

    pool: str
    fold: int
    origin: int  # day
    base: float = 0.0
    has_tail: bool = False
    has_fit: bool = True
    trees: list[gbt.Tree] = field(default_factory=list)
    best: float = np.inf
    at: int = 0
    open: bool = True


@dataclass(frozen=True)
class _Job:
    """What a task has to know of the fits of one pool: trees since the scores were written, and the levels grown of the current tree."""

    fold: int
    origin: int
    all_fit: bool
    trees: tuple[gbt.Tree, ...] = ()
    levels: tuple = ()
    live: tuple[int, ...] = (0,)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(pool, columns, codes, scores) of each run of rows of one pool."""
    for batch in batches:
        pools = batch.column(0).to_pylist()
        cuts = [0, *(k for k in range(1, len(pools)) if pools[k] != pools[k - 1]), len(pools)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                columns = {n: part.column(part.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("row_key", "oday", "tday", "y", "level")}
                lists = [np.asarray(part.column(part.schema.get_field_index(n)).flatten()).reshape(b - a, -1) for n in ("codes", "scores")]
                yield pools[a], columns, lists[0], lists[1]


def _weights(c: dict[str, np.ndarray], origin: int, is_fit: np.ndarray, recent: bool) -> np.ndarray:
    return np.where(is_fit, 0.5 ** ((origin - c["tday"]) / HALF_LIFE), 1.0) if recent else np.ones(len(is_fit))


def _parts(c: dict[str, np.ndarray], job: _Job) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are fitted on, and rows that decide when to stop."""
    train = c["tday"] <= job.origin
    is_fit = train if job.all_fit else c["tday"] <= job.origin - TAIL_DAYS
    return is_fit, train & ~is_fit


def _scores(codes: np.ndarray, scores: np.ndarray, job: _Job) -> np.ndarray:
    return scores + sum((gbt.apply(t, codes) for t in job.trees), np.zeros(len(codes)))


class Pools:
    """The fits of all pools over all origins. kind, tau: the loss; relative, recent: as for models that are fitted in one task."""

    def __init__(self, rows: DataFrame, names: list[str], origins: list[tuple[int, np.datetime64]], settings: gbt.Settings, known: dict[str, list[np.ndarray]], kind: str = "squared", tau: float = 0.5, relative: bool = False, recent: bool = False):
        self.settings, self.loss, self.names = settings, gbt.Loss(kind, tau), names
        self.recent, self.relative, self.known = recent, relative, known
        self.days = {k: int((o - EPOCH).astype(int)) for k, o in origins}
        self.spark = rows.sparkSession
        self.folds = list(self.days)
        self.fits = {(p, k): _Fit(p, k, self.days[k]) for p in known for k in self.folds}
        level = F.col("roll_mean_28").cast("double")
        plain = rows.select(
            F.col("pool").cast("string").alias("pool"), "id", F.col("horizon").cast("int").alias("horizon"), "row_key", F.unix_date("origin_date").alias("oday"), F.unix_date("target_date").alias("tday"),
            (F.col("target") - (level if relative else 0)).cast("double").alias("y"), level.alias("level"), F.array(*(F.col(c).cast("double") for c in names)).alias("x"),
        )
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = plain.repartitionByRange(tasks, "pool", "row_key").sortWithinPartitions("pool")
        self.state = cut(self._coded(dealt))
        self._start()

    def _coded(self, rows: DataFrame) -> DataFrame:
        known, n_folds = self.known, len(self.folds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(8).flatten()).astype(float).reshape(batch.num_rows, -1)
                pools = np.array(batch.column(0).to_pylist(), object)
                codes = np.zeros(x.shape, np.int32)
                for p in set(pools):
                    codes[pools == p] = gbt.Binner(known[p])(x[pools == p])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w, pa.int32()), pa.array(v)) for w, v in ((x.shape[1], codes.ravel()), (n_folds, np.zeros(len(x) * n_folds)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:8], *lists], names=[*batch.schema.names[:8], "codes", "scores"])

        return rows.mapInArrow(run, "pool string, id string, horizon int, row_key long, oday int, tday int, y double, level double, codes array<int>, scores array<double>")

    def _jobs(self, fits: list[_Fit], since: int, levels: dict[tuple[str, int], tuple] | None = None, live: dict | None = None) -> dict[str, list[_Job]]:
        out: dict[str, list[_Job]] = {}
        for f in fits:
            key = (f.pool, f.fold)
            out.setdefault(f.pool, []).append(_Job(f.fold, f.origin, not f.has_fit, tuple(f.trees[since:]), (levels or {}).get(key, ()), tuple((live or {}).get(key, (0,)))))
        return out

    def _start(self) -> None:
        """The starting score of each fit, and whether it has rows to fit on and a tail."""
        each = self.state.select("pool", "tday", "y").withColumn("_f", F.explode(F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(day).alias("origin")) for f, day in self.days.items())))).select("pool", "tday", "y", "_f.fold", "_f.origin").filter("tday <= origin")
        is_fit = F.col("tday") <= F.col("origin") - TAIL_DAYS
        weight = F.pow(F.lit(0.5), (F.col("origin") - F.col("tday")) / HALF_LIFE) if self.recent else F.lit(1.0)

        def start(rows: Column, w: Column) -> Column:
            y = F.when(rows, F.col("y"))
            return F.percentile(y, self.loss.tau) if self.loss.kind == "pinball" else F.try_divide(F.sum(y * w), F.sum(F.when(rows, w)))

        found = each.groupBy("pool", "fold").agg(F.sum(is_fit.cast("long")).alias("n_fit"), F.count("*").alias("n"), start(is_fit, weight).alias("a"), start(F.lit(True), F.lit(1.0)).alias("b")).collect()
        seen = set()
        for r in found:
            f = self.fits[r["pool"], r["fold"]]
            f.has_fit, f.has_tail = r["n_fit"] > 0, 0 < r["n_fit"] < r["n"]
            value = r["a"] if f.has_fit else r["b"]
            f.base = value if self.loss.kind == "pinball" else self.loss.start_of_mean(value)
            seen.add((r["pool"], r["fold"]))
        self.fits = {k: f for k, f in self.fits.items() if k in seen}

    def _level(self, fits: list[_Fit], since: int, turn: int, chosen: dict[str, gbt.Chosen], levels: dict, live: dict, want_loss: bool) -> tuple[dict, dict]:
        """Best splits by (pool, fold): node -> (column, limit, ends); and sums of the loss of tails."""
        jobs, s, loss, recent, folds = self._jobs(fits, since, levels, live), self.settings, self.loss, self.recent, self.folds
        bases = {(f.pool, f.fold): f.base for f in fits}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], list] = {}

            def told() -> Iterator[pa.RecordBatch]:
                for (pool, fold), (by_node, tail) in sums.items():
                    live_nodes, found = by_node
                    at, bins = np.nonzero(found[1] != 0)
                    columns = [np.array(live_nodes)[at], bins, found[0][at, bins], found[1][at, bins]]
                    if tail[1]:
                        columns = [np.append(c, v) for c, v in zip(columns, (-1, -1, tail[0], tail[1]), strict=True)]
                    if len(columns[0]):
                        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array([pool] * len(columns[0]), pa.string()), pa.array([fold] * len(columns[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["pool", "fold", "node", "bin", "g", "h"])
                sums.clear()

            for pool, c, codes, scores in _batches(batches):
                if sums and next(iter(sums))[0] != pool:
                    yield from told()
                for job in jobs.get(pool, ()):
                    is_fit, tail = _parts(c, job)
                    key = (pool, job.fold)
                    if key not in sums:
                        sums[key] = [(job.live, np.zeros((2, len(job.live), chosen[pool].total))), [0.0, 0]]
                    f = None
                    rows = np.flatnonzero(is_fit & gbt.sampled(c["row_key"], s.seed, turn, s.rows))
                    of = lambda at, job=job: _scores(codes[at], scores[at, folds.index(job.fold)], job) + bases[pool, job.fold]
                    if want_loss and tail.any():
                        at = np.flatnonzero(tail)
                        sums[key][1][0] += float(loss.values(c["y"][at], of(at)).sum())
                        sums[key][1][1] += len(at)
                    if len(rows) and job.live:
                        node = np.zeros(len(rows), np.int64)
                        for column, limit in job.levels:
                            node = gbt.descend(node, codes[rows], column, limit)
                        place = np.full(1 << len(job.levels), -1)
                        place[list(job.live)] = np.arange(len(job.live))
                        inside = place[node] >= 0
                        rows, node = rows[inside], place[node[inside]]
                        f = of(rows)
                        w = _weights({k: v[rows] for k, v in c.items()}, job.origin, np.ones(len(rows), bool) if not job.all_fit else is_fit[rows] & (c["tday"][rows] <= job.origin - TAIL_DAYS), recent)
                        g, h = loss.gradient(c["y"][rows], f)
                        sums[key][0][1][:] += gbt.histogram(chosen[pool].codes(codes[rows]), node, len(job.live), chosen[pool].total, g * w, h * w)
            yield from told()

        totals = {p: c.total for p, c in chosen.items()}

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            if first["node"] < 0:
                return pd.DataFrame([(first["pool"], first["fold"], -1, 0, 0, pdf["g"].sum(), pdf["h"].sum(), 0.0, 0.0)], columns=OUT)
            sums = np.zeros((2, 1, totals[first["pool"]]))
            sums[0, 0, pdf["bin"]], sums[1, 0, pdf["bin"]] = pdf["g"], pdf["h"]
            column, limit, ends = gbt.best_splits(sums, chosen[first["pool"]], s)
            return pd.DataFrame([(first["pool"], first["fold"], first["node"], column[0], limit[0], *ends[:, 0])], columns=OUT)

        added = self.state.mapInArrow(run, "pool string, fold int, node int, bin int, g double, h double").groupBy("pool", "fold", "node", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        splits, losses = {}, {}
        for r in added.groupBy("pool", "fold", "node").applyInPandas(split, "pool string, fold int, node int, column int, limit int, lg double, lh double, rg double, rh double").collect():
            if r["node"] < 0:
                losses[r["pool"], r["fold"]] = r["lg"] / r["lh"]
            else:
                splits.setdefault((r["pool"], r["fold"]), {})[r["node"]] = (r["column"], r["limit"], np.array([r["lg"], r["lh"], r["rg"], r["rh"]]))
        return splits, losses

    def _quantiles(self, fits: list[_Fit], since: int, turn: int, grown: dict[tuple[str, int], list]) -> dict[tuple[str, int], np.ndarray]:
        """The tau-quantile of residuals in each leaf of the current trees."""
        jobs, s, folds = self._jobs(fits, since, {k: tuple(v) for k, v in grown.items()}), self.settings, self.folds
        bases = {(f.pool, f.fold): f.base for f in fits}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pool, c, codes, scores in _batches(batches):
                for job in jobs.get(pool, ()):
                    rows = np.flatnonzero(_parts(c, job)[0] & gbt.sampled(c["row_key"], s.seed, turn, s.rows))
                    if len(rows) and job.levels:
                        node = np.zeros(len(rows), np.int64)
                        for column, limit in job.levels:
                            node = gbt.descend(node, codes[rows], column, limit)
                        rest = c["y"][rows] - _scores(codes[rows], scores[rows, folds.index(job.fold)], job) - bases[pool, job.fold]
                        yield pa.RecordBatch.from_arrays([pa.array([pool] * len(rows), pa.string()), pa.array([job.fold] * len(rows), pa.int32()), pa.array(node, pa.int32()), pa.array(rest)], names=["pool", "fold", "leaf", "rest"])

        found = self.state.mapInArrow(run, "pool string, fold int, leaf int, rest double").groupBy("pool", "fold", "leaf").agg(F.percentile("rest", self.loss.tau).alias("q"))
        out = {k: np.zeros(1 << s.depth) for k in grown}
        for r in found.collect():
            out[r["pool"], r["fold"]][r["leaf"]] = r["q"] * s.eta
        return out

    def _refresh(self, since: int) -> None:
        """Writes the scores with the trees grown since they were written."""
        jobs, folds = self._jobs(list(self.fits.values()), since), self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = np.asarray(batch.column(9).flatten()).reshape(batch.num_rows, -1).copy()
                pools = np.array(batch.column(0).to_pylist(), object)
                codes = np.asarray(batch.column(8).flatten()).reshape(batch.num_rows, -1)
                for p in set(pools):
                    at = np.flatnonzero(pools == p)
                    for job in jobs.get(p, ()):
                        new[at, folds.index(job.fold)] = _scores(codes[at], new[at, folds.index(job.fold)], job)
                yield pa.RecordBatch.from_arrays([*batch.columns[:9], pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * new.shape[1], pa.int32()), pa.array(new.ravel()))], names=batch.schema.names)

        self.state = cut(self.state.mapInArrow(run, self.state.schema))

    def grow(self) -> Pools:
        s, since, tails = self.settings, 0, [f for f in self.fits.values() if f.has_tail]
        binners = {p: gbt.Binner(e) for p, e in self.known.items()}
        turn = 0
        while True:
            last = turn >= s.rounds
            fits = [f for f in self.fits.values() if f.open and (f.has_tail or turn < min(s.rounds, s.no_tail_rounds))]
            if not fits:
                break
            columns = gbt.chosen_columns(len(self.names), s.seed, turn, s.columns)
            chosen = {p: gbt.Chosen(b, columns) for p, b in binners.items()}
            grown: dict[tuple[str, int], list] = {(f.pool, f.fold): [] for f in fits}
            live: dict[tuple[str, int], list[int]] = {k: [] if last else [0] for k in grown}
            ends: dict[tuple[str, int], dict[int, np.ndarray]] = {}
            for depth in range(1 if last else s.depth):
                splits, losses = self._level(fits, since, turn, chosen, {k: tuple(v) for k, v in grown.items()}, live, want_loss=depth == 0)
                if depth == 0:
                    for f in tails:
                        if (f.pool, f.fold) in losses and f.trees:
                            if losses[f.pool, f.fold] < f.best - 1e-12:
                                f.best, f.at = losses[f.pool, f.fold], len(f.trees)
                            elif len(f.trees) - f.at >= s.patience:
                                f.open = False
                    fits = [f for f in fits if f.open and (f.pool, f.fold) in splits]
                    grown = {k: v for k, v in grown.items() if k in {(f.pool, f.fold) for f in fits}}
                for k in grown:
                    column, limit = np.zeros(1 << depth, np.int64), np.full(1 << depth, binners[k[0]].total)
                    after, next_live = {}, []
                    for node, (c, at, e) in splits.get(k, {}).items():
                        column[node], limit[node] = c, at
                        after[2 * node], after[2 * node + 1] = e[:2], e[2:]
                        if at < binners[k[0]].total:
                            next_live += [2 * node, 2 * node + 1]
                    for node, e in ends.get(k, {}).items():
                        if node not in splits.get(k, {}):  # closed above: all rows go left
                            after[2 * node] = e
                    ends[k], live[k] = after, sorted(next_live)
                    grown[k].append((column, limit))
            if last:
                break
            steps = self._quantiles(fits, since, turn, grown) if self.loss.kind == "pinball" and fits else None
            for f in fits:
                k = (f.pool, f.fold)
                value = np.zeros(1 << s.depth)
                for leaf, (g, h) in ends[k].items():
                    value[leaf] = -g / (h + s.l2) * s.eta
                f.trees.append((grown[k], value if steps is None else steps[k]))
            turn += 1
            if turn - since >= REFRESH and all(len(f.trees) == turn for f in fits):
                self._refresh(since)
                since = turn
        for f in tails:
            f.trees = f.trees[: max(f.at, 1)]
        return self

    def predict(self) -> DataFrame:
        """(id, fold, horizon, forecast, fallback) of the rows whose origin is a fold's; where nothing could be fitted, the 28-day mean."""
        fits, days, loss, relative = self.fits, self.days, self.loss, self.relative

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pools, oday = np.array(batch.column(0).to_pylist(), object), np.asarray(batch.column(3))
                codes, level = np.asarray(batch.column(5).flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column(4))
                for p in set(pools):
                    for k, day in days.items():
                        at = np.flatnonzero((pools == p) & (oday == day))
                        if len(at):
                            f = fits.get((p, k))
                            value = level[at] if f is None else loss.link(f.base + sum((gbt.apply(t, codes[at]) for t in f.trees), np.zeros(len(at)))) + (level[at] if relative else 0)
                            own = pa.array(at)
                            columns = [batch.column(1).take(own), pa.array([k] * len(at), pa.int64()), batch.column(2).take(own), pa.array(np.maximum(value, 0)), pa.array([f is None] * len(at))]
                            yield pa.RecordBatch.from_arrays(columns, names=["id", "fold", "horizon", "forecast", "fallback"])

        return self.state.select("pool", "id", "horizon", "oday", "level", "codes").mapInArrow(run, "id string, fold long, horizon int, forecast double, fallback boolean")


OUT = ["pool", "fold", "node", "column", "limit", "lg", "lh", "rg", "rh"]
