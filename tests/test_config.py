from datetime import date, timedelta

import pytest

from stockcast.config import Config, suite_config, suite_of


def test_layout_arithmetic():
    cfg, last = Config(), date(2001, 11, 4)
    assert cfg.test_days_total == 364
    assert cfg.holdout_start(last) == date(2000, 11, 6)
    origins = cfg.origins(last)
    assert origins[0] == date(2000, 11, 5) and len(origins) == 52
    assert origins[-1] + timedelta(days=7) == last


@pytest.mark.parametrize("bad", [{"horizon": 0}, {"n_folds": 0}, {"fold_step": 0}, {"test_window": 8}, {"rmsse_scale_lag": 0}, {"pool_by": "x"}, {"rmsse_scale_window": "x"}, {"horizon": 400}])
def test_rejections(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_suites():
    assert suite_of(suite_config("weekly")) == "weekly"
    assert suite_of(suite_config("dev", store_ids=("b", "a"))) == "dev"
    assert suite_of(suite_config("dev")) is None
    assert Config(store_ids=("b", "a")).store_ids == ("a", "b")
    with pytest.raises(ValueError):
        suite_config("monthly")
