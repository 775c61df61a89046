"""The one definition of an experiment: which series, which folds, which scale."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import date, timedelta

POOLS = (None, "item_id", "dept_id", "cat_id", "store_id", "state_id")
SCALE_WINDOWS = ("pre_holdout", "per_fold")


@dataclass(frozen=True)
class Config:
    horizon: int = 7
    test_window: int | None = None  # the horizon, if not given
    season: int = 7
    n_folds: int = 52
    fold_step: int = 7
    min_train_days: int = 365
    rmsse_scale_lag: int | None = None  # the season, if not given
    rmsse_scale_window: str = "pre_holdout"
    item_ids: tuple[str, ...] = ()
    store_ids: tuple[str, ...] = ()
    dept_id: str | None = None
    cat_id: str | None = None
    pool_by: str | None = None
    use_price: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        fill = object.__setattr__
        fill(self, "test_window", self.horizon if self.test_window is None else self.test_window)
        fill(self, "rmsse_scale_lag", self.season if self.rmsse_scale_lag is None else self.rmsse_scale_lag)
        fill(self, "item_ids", tuple(sorted(self.item_ids)))
        fill(self, "store_ids", tuple(sorted(self.store_ids)))
        for name in ("horizon", "n_folds", "fold_step", "rmsse_scale_lag", "test_window"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.test_window > self.horizon:
            raise ValueError("test_window must not exceed horizon")
        if self.horizon > 364:
            raise ValueError("horizon must be 364 or less: the yearly benchmark looks back 364 days")
        if self.pool_by not in POOLS:
            raise ValueError(f"pool_by must be one of {POOLS}")
        if self.rmsse_scale_window not in SCALE_WINDOWS:
            raise ValueError(f"rmsse_scale_window must be one of {SCALE_WINDOWS}")

    @property
    def test_days_total(self) -> int:
        return (self.n_folds - 1) * self.fold_step + self.test_window

    def holdout_start(self, last: date) -> date:
        return last - timedelta(days=self.test_days_total - 1)

    def origins(self, last: date) -> list[date]:
        start = self.holdout_start(last)
        return [start + timedelta(days=k * self.fold_step - 1) for k in range(self.n_folds)]

    def subset(self) -> dict[str, object]:
        """The series filters that are set."""
        return {k: v for k in ("item_ids", "store_ids", "dept_id", "cat_id") if (v := getattr(self, k))}

    def describe(self) -> str:
        scope = ", ".join(f"{k}={v}" for k, v in self.subset().items()) or "all series"
        pool = f", pooled by {self.pool_by}" if self.pool_by else ""
        return f"{scope}: {self.n_folds} folds of {self.test_window} days every {self.fold_step} days, horizon {self.horizon}{pool}"

    def fields(self) -> dict[str, str]:
        return {k: repr(v) for k, v in asdict(self).items()}


#: The named layouts, (folds, step).
LAYOUTS = {"dev": (8, 7), "weekly": (52, 7), "everyday": (358, 1), "two_year": (104, 7)}
DEV_STORES = 3


def suite_config(name: str, **fields: object) -> Config:
    if name not in LAYOUTS:
        raise ValueError(f"unknown suite {name!r}; known: {', '.join(LAYOUTS)}")
    n, step = LAYOUTS[name]
    return Config(n_folds=n, fold_step=step, **fields)


def suite_of(cfg: Config) -> str | None:
    """The layout's name; dev runs have store filters, the others none."""
    for name, layout in LAYOUTS.items():
        if (cfg.n_folds, cfg.fold_step) == layout and bool(cfg.store_ids) == (name == "dev"):
            return name
    return None


def unpooled(cfg: Config) -> Config:
    return replace(cfg, pool_by=None)
