"""DuckDB SQL for the catalogue: the same results by another route, as materialized common table expressions."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from ..config import Config, suite_config, suite_of
from ..operators import calendar as cal

P: dict[str, str] = {}
#: The dates of moving events in the years of the tables, as published.
MOVING_EVENTS = {
    "Thanksgiving": "1995-11-23 1996-11-28 1997-11-27 1998-11-26 1999-11-25 2000-11-23 2001-11-22",
    "LaborDay": "1995-09-04 1996-09-02 1997-09-01 1998-09-07 1999-09-06 2000-09-04 2001-09-03",
    "Easter": "1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15",
}
ORACLES: dict[str, str] = {}


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + " END"


def _list(values: object) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


_first = _case([(f"strftime(date, '%Y-%m-%d') IN ({_list(d.split())})", n) for n, d in MOVING_EVENTS.items()] + [(f"strftime(date, '%m-%d') = '{d}'", n) for n, d in cal.YEARLY_EVENTS.items()])
_second = _case([(f"date = DATE '{d}'", n) for d, n in cal.SECOND_EVENTS.items()])
P["bounds"] = "SELECT MIN(CAST(l_shipdate AS DATE)) AS lo, MAX(CAST(l_shipdate AS DATE)) AS hi FROM lineitem"
P["days"] = "SELECT CAST(unnest(generate_series(lo, hi + INTERVAL 40 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds"
P["named"] = f"SELECT date, {_first} AS event_name_1, {_second} AS event_name_2, " + ", ".join(f"CASE WHEN day(date) IN ({_list(d)}) THEN 1 ELSE 0 END AS snap_{s}" for s, d in cal.BENEFIT_DAYS.items()) + " FROM days"
P["majors"] = f"SELECT date FROM named WHERE event_name_1 IN ({_list(cal.MAJOR)}) OR event_name_2 IN ({_list(cal.MAJOR)})"
P["cal"] = """SELECT n.*, CASE WHEN n.date IN (SELECT date FROM majors) THEN 1 ELSE 0 END AS is_holiday,
  LEAST(30, COALESCE((SELECT MIN(date_diff('day', n.date, m.date)) FROM majors m WHERE m.date >= n.date), 30)) AS days_to_holiday,
  LEAST(30, COALESCE((SELECT MIN(date_diff('day', m.date, n.date)) FROM majors m WHERE m.date <= n.date), 30)) AS days_since_holiday,
  COALESCE(event_name_1 = 'Christmas', false) OR COALESCE(event_name_2 = 'Christmas', false) AS closure FROM named n"""
P["lines_dense"] = "SELECT l_returnflag AS id, 'ALL' AS item_id, l_returnflag AS store_id, CASE l_returnflag WHEN 'A' THEN 'CA' WHEN 'N' THEN 'TX' WHEN 'R' THEN 'WI' END AS state_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice AS value FROM lineitem"
P["lines_sparse"] = """SELECT p_type || '_' || r_name AS id, p_type AS item_id, r_name AS store_id, CASE r_regionkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'WI' END AS state_id,
  CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
P["lines_mid"] = "SELECT p_type || '_' || l_returnflag AS id, p_type AS item_id, l_returnflag AS store_id, CASE l_returnflag WHEN 'A' THEN 'CA' WHEN 'N' THEN 'TX' WHEN 'R' THEN 'WI' END AS state_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice AS value FROM lineitem JOIN part ON p_partkey = l_partkey"
for k in ("dense", "sparse", "mid"):
    P[f"raw_{k}"] = f"SELECT id, item_id, store_id, state_id, date, SUM(quantity) AS sales FROM lines_{k} GROUP BY ALL"
    P[f"spans_{k}"] = f"SELECT id, item_id, store_id, state_id, MIN(date) AS first FROM raw_{k} GROUP BY ALL"
    P[f"grid_{k}"] = f"SELECT s.id, s.item_id, s.store_id, s.state_id, d.date FROM spans_{k} s JOIN days d ON d.date >= s.first AND d.date <= (SELECT hi FROM bounds)"
    P[f"base_{k}"] = f"""SELECT g.*, r.sales IS NULL AS is_filled, CASE WHEN c.closure THEN 0.0 ELSE COALESCE(r.sales, 0.0) END AS unfilled, c.event_name_1, c.event_name_2, c.is_holiday, c.days_to_holiday, c.days_since_holiday, c.closure,
  CASE g.state_id WHEN 'CA' THEN snap_CA WHEN 'TX' THEN snap_TX WHEN 'WI' THEN snap_WI END AS snap FROM grid_{k} g JOIN cal c USING (date) LEFT JOIN raw_{k} r ON r.id = g.id AND r.date = g.date"""
    P[f"fill_{k}"] = f"""SELECT c.id, c.date, COALESCE(AVG(p.unfilled), 0.0) AS sales FROM base_{k} c CROSS JOIN (VALUES (1), (2), (3), (4)) w(n)
  LEFT JOIN base_{k} p ON p.id = c.id AND p.date = c.date - CAST(7 * w.n AS INTEGER) AND NOT p.closure AND NOT (p.days_to_holiday <= 2 OR p.days_since_holiday <= 1) WHERE c.closure GROUP BY ALL"""
    P[f"panel_{k}"] = f"SELECT b.* EXCLUDE (unfilled), COALESCE(f.sales, b.unfilled) AS sales FROM base_{k} b LEFT JOIN fill_{k} f ON f.id = b.id AND f.date = b.date"
    P[f"prices_{k}"] = f"SELECT id, CAST(date_trunc('week', date) AS DATE) AS week, floor(CAST(SUM(CAST(value / NULLIF(quantity, 0) AS DECIMAL(18, 8))) AS DOUBLE) / COUNT(quantity) * 10000 + 0.5) / 10000 AS sell_price FROM lines_{k} GROUP BY ALL"
    P[f"priced_{k}"] = f"SELECT p.*, q.sell_price FROM panel_{k} p LEFT JOIN prices_{k} q ON q.id = p.id AND q.week = CAST(date_trunc('week', p.date) AS DATE)"
LAYOUTS = {"weekly": 52, "dev": 8, "two": 104}
for name, n in LAYOUTS.items():
    P[f"folds_{name}"] = f"SELECT CAST(k AS BIGINT) AS fold, CAST(hi - {(n - 1) * 7 + 7 - 1} + CAST(7 * k - 1 AS INTEGER) AS DATE) AS origin FROM bounds, range({n}) r(k)"
    P[f"holdout_{name}"] = f"SELECT CAST(hi - {(n - 1) * 7 + 7 - 1} AS DATE) AS day FROM bounds"
    for k in ("dense", "sparse", "mid"):
        P[f"hist_{k}_{name}"] = f"""SELECT p.id, p.item_id, p.store_id, f.fold, f.origin, COUNT(*) AS n_history, AVG(p.sales) AS m, arg_min(p.sales, p.date) AS y1, arg_max(p.sales, p.date) AS yt,
  AVG(CASE WHEN p.date > f.origin - 28 THEN p.sales END) AS ma28 FROM folds_{name} f JOIN panel_{k} p ON p.date <= f.origin GROUP BY ALL"""
        P[f"diffs_{k}"] = f"SELECT a.id, a.date, a.sales - b.sales AS d FROM panel_{k} a JOIN panel_{k} b ON b.id = a.id AND b.date = a.date - 7"
        P[f"scale_{k}_{name}"] = f"SELECT id, sqrt(AVG(d * d)) AS scale FROM diffs_{k} WHERE date < (SELECT day FROM holdout_{name}) GROUP BY id"
        P[f"days_{k}_{name}"] = f"""SELECT h.*, t.n AS horizon, a.date AS target_date, a.sales AS actual, a.closure, (a.days_to_holiday <= 2 OR a.days_since_holiday <= 1) AS holiday_window,
  COUNT(*) OVER (PARTITION BY h.id, h.fold) AS n_targets, bool_or(a.days_to_holiday <= 2 OR a.days_since_holiday <= 1) OVER (PARTITION BY h.id, h.fold) AS any_holiday
  FROM hist_{k}_{name} h CROSS JOIN range(1, 8) t(n) JOIN panel_{k} a ON a.id = h.id AND a.date = h.origin + CAST(t.n AS INTEGER)"""
        P[f"made_{k}_{name}"] = f"""SELECT d.*, s.scale, CASE WHEN any_holiday THEN 'holiday' ELSE 'normal' END AS week_kind,
  CASE WHEN n_history >= 7 THEN w.sales ELSE yt END AS f_season, y.sales AS f_year
  FROM days_{k}_{name} d LEFT JOIN scale_{k}_{name} s ON s.id = d.id LEFT JOIN panel_{k} w ON w.id = d.id AND w.date = d.origin + CAST(d.horizon AS INTEGER) - 7
  LEFT JOIN panel_{k} y ON y.id = d.id AND y.date = d.origin + CAST(d.horizon AS INTEGER) - 364 WHERE n_history >= 365 AND n_targets = 7"""
        P[f"pred_{k}_{name}"] = f"""SELECT id, item_id, store_id, fold, origin, week_kind, method, 'benchmark' AS kind, horizon, target_date, actual, forecast, scale, closure, holiday_window, false AS fallback FROM (
  SELECT *, unnest([{{'method': 'mean', 'forecast': m}}, {{'method': 'naive', 'forecast': yt}}, {{'method': 'seasonal_naive', 'forecast': f_season}},
    {{'method': 'drift', 'forecast': yt + horizon * ((yt - y1) / (n_history - 1))}}, {{'method': 'moving_average_28', 'forecast': ma28}},
    {{'method': 'seasonal_naive_364', 'forecast': f_year}}], recursive := true) FROM made_{k}_{name})"""
        P[f"score_{k}_{name}"] = f"""SELECT id, item_id, store_id, fold, origin, week_kind, method, kind, sqrt(AVG((forecast - actual) ** 2)) AS rmse, AVG(abs(forecast - actual)) AS mae, AVG(forecast - actual) AS bias,
  CASE WHEN MIN(scale) > 0 THEN sqrt(AVG((forecast - actual) ** 2)) / MIN(scale) END AS rmsse, bool_or(fallback) AS fallback, COUNT(*) AS n_days, AVG(actual) AS mean_actual,
  NOT COALESCE(MIN(scale) > 0, false) AS unscored FROM pred_{k}_{name} WHERE NOT closure GROUP BY ALL"""
        P[f"week_{k}_{name}"] = f"""SELECT id, item_id, store_id, fold, origin, week_kind, method, kind, SUM(actual) AS actual, SUM(forecast) AS forecast, COUNT(*) AS n_days, MIN(scale) AS scale, SUM(actual) - SUM(forecast) AS error
  FROM pred_{k}_{name} WHERE NOT closure GROUP BY ALL"""
    P[f"from_{name}"] = f"SELECT origin AS day FROM folds_{name} WHERE fold = {n // 2}"


def chain(final: str) -> str:
    """The final select with the expressions that it needs in front, in order of need."""
    done: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z]+(?:_[a-z0-9]+)*\b", text)):
            if word in P and word not in done:
                need(P[word])
                done.append(word)

    need(final)
    return (("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({P[n]})" for n in done) + "\n") if done else "") + final


def oracle(name: str, sql: str, doubles: str = "", ints: str = "") -> None:
    fixed = [f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.5001) / 1e6 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    ORACLES[name] = chain(f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({sql}) AS t" if fixed else sql)


_panel = "id, item_id, store_id, state_id, date, sales, is_filled, event_name_1, event_name_2, is_holiday, days_to_holiday, days_since_holiday, closure, snap"
for k in ("dense", "sparse", "mid"):
    oracle(f"panel_{k}", f"SELECT {_panel} FROM panel_{k}", "sales", "is_holiday days_to_holiday days_since_holiday snap")
oracle("panel_profile", "SELECT COUNT(DISTINCT id) AS n_series, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date, AVG(is_filled::INT::DOUBLE) AS filled_share, COUNT(*) FILTER (closure) AS n_closed, AVG((sales = 0)::INT::DOUBLE) AS zero_share FROM panel_sparse", "filled_share zero_share")
oracle("grid_gaps", "SELECT id, date, gap FROM (SELECT id, date, date_diff('day', LAG(date) OVER (PARTITION BY id ORDER BY date), date) AS gap FROM raw_sparse) WHERE gap <> 1", "", "gap")
oracle("unpivot_sales", "SELECT s.id, s.store_id, s.year, 'd_' || m.k AS d, SUM(l.quantity) AS sales FROM (SELECT DISTINCT id, store_id, year(date) AS year FROM lines_dense) s CROSS JOIN range(1, 13) m(k) LEFT JOIN lines_dense l ON l.id = s.id AND year(l.date) = s.year AND month(l.date) = m.k GROUP BY ALL", "sales")
oracle("calendar_features", "SELECT id, date, isodow(date) - 1 AS dow, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, day(date) AS day_of_month, month(date) AS month, dayofyear(date) AS day_of_year, CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END AS is_event, snap FROM panel_dense", "", "dow is_weekend day_of_month month day_of_year is_event snap")
oracle("holiday_proximity", "SELECT date, event_name_1, event_name_2, is_holiday, days_to_holiday, days_since_holiday, closure FROM cal", "", "is_holiday days_to_holiday days_since_holiday")
oracle("holiday_window", "SELECT DISTINCT d.date FROM days d JOIN majors m ON d.date BETWEEN m.date - 2 AND m.date + 1")
oracle("snap_flag", "SELECT id, state_id, SUM(snap) AS snap_days FROM panel_sparse GROUP BY ALL", "", "snap_days")
oracle("price_join", "SELECT id, date, sell_price FROM priced_sparse", "sell_price")
oracle("prelaunch_trim", "SELECT id, MIN(date) AS first_date, COUNT(*) AS n_days FROM panel_sparse p WHERE date >= (SELECT MIN(q.date) FROM priced_sparse q WHERE q.id = p.id AND q.sell_price IS NOT NULL AND q.date >= DATE '1996-01-01') GROUP BY id")
oracle("closure_impute", "SELECT id, date, sales FROM panel_dense WHERE closure", "sales")
oracle("fold_layout", "SELECT fold, origin FROM folds_weekly")
oracle("fold_eligibility", "SELECT p.id, f.fold, COUNT(*) FILTER (p.date <= f.origin) AS n_history, COUNT(*) FILTER (p.date > f.origin AND p.date <= f.origin + 7) AS n_targets, COUNT(*) FILTER (p.date <= f.origin) >= 365 AND COUNT(*) FILTER (p.date > f.origin AND p.date <= f.origin + 7) = 7 AS eligible FROM panel_sparse p CROSS JOIN folds_two f GROUP BY ALL HAVING bool_or(p.date = f.origin)")
oracle("week_kind", "SELECT DISTINCT id, fold, week_kind FROM made_dense_weekly")
_w = "OVER (PARTITION BY id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
oracle("lag_features", "SELECT id, date, " + ", ".join(f"LAG(sales, {j - 1}) OVER (PARTITION BY id ORDER BY date) AS lag_{j}" for j in (1, 2, 3, 7, 14, 21, 28)) + " FROM panel_dense", " ".join(f"lag_{j}" for j in (1, 2, 3, 7, 14, 21, 28)))
_roll = ", ".join(f"{f}(sales) {_w.format(w - 1)} AS roll_{s}_{w}" for w in (7, 28, 56) for s, f in (("mean", "AVG"), ("std", "stddev_samp")))
oracle("rolling_features", f"SELECT id, date, {_roll} FROM panel_dense", " ".join(f"roll_{s}_{w}" for w in (7, 28, 56) for s in ("mean", "std")))
_trend = f"AVG(sales) {_w.format(6)} / NULLIF(AVG(sales) {_w.format(55)}, 0) - 1"
oracle("trend_feature", f"SELECT id, date, {_trend} AS trend_7_56 FROM panel_dense", "trend_7_56")
_dow = ", ".join(f"AVG(sales) OVER (PARTITION BY id, isodow(date) ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS dow_mean_{k}" for k in (4, 8))
oracle("dow_means", f"SELECT id, date, {_dow} FROM panel_dense", "dow_mean_4 dow_mean_8")
P["seen"] = f"SELECT id, date, sales AS lag_1, LAG(sales, 27) OVER (PARTITION BY id ORDER BY date) AS lag_28, AVG(sales) {_w.format(27)} AS roll_mean_28, stddev_samp(sales) {_w.format(55)} AS roll_std_56, {_trend} AS trend_7_56, ROW_NUMBER() OVER (PARTITION BY id ORDER BY date) - 1 AS i, COUNT(*) OVER (PARTITION BY id) AS n FROM panel_dense"
P["weekday_means"] = f"SELECT id, date, {_dow} FROM panel_dense"
P["sup"] = """SELECT o.id, o.date AS origin_date, t.h AS horizon, a.date AS target_date, a.sales AS target, o.lag_1, o.lag_28, o.roll_mean_28, o.roll_std_56, o.trend_7_56, w.dow_mean_4, w.dow_mean_8,
  isodow(a.date) - 1 AS dow, a.snap, CASE WHEN a.event_name_1 IS NULL THEN 0 ELSE 1 END AS is_event, a.days_to_holiday
  FROM seen o CROSS JOIN range(1, 8) t(h) JOIN panel_dense a ON a.id = o.id AND a.date = o.date + CAST(t.h AS INTEGER) JOIN weekday_means w ON w.id = o.id AND w.date = a.date - 7 WHERE o.i >= 56 AND o.i <= o.n - 8"""
oracle("supervised_matrix", "SELECT * FROM sup", "target lag_1 lag_28 roll_mean_28 roll_std_56 trend_7_56 dow_mean_4 dow_mean_8", "horizon dow snap is_event days_to_holiday")
oracle("relative_target", "SELECT id, origin_date, horizon, target - roll_mean_28 AS relative FROM sup", "relative")
P["first_origin"] = "SELECT MIN(origin) AS day FROM folds_weekly"
oracle("recency_weight", "SELECT id, origin_date, horizon, pow(0.5, date_diff('day', target_date, (SELECT day FROM first_origin)) / 365.0) AS weight FROM sup WHERE target_date <= (SELECT day FROM first_origin)", "weight")
oracle("trainable_rows", "SELECT id, target_date <= (SELECT day FROM first_origin) - 90 AS is_fit, COUNT(*) AS n, MAX(target_date) AS last_target FROM sup WHERE target_date <= (SELECT day FROM first_origin) GROUP BY ALL")
oracle("arima_regressors", "SELECT id, date, is_holiday::DOUBLE AS x_holiday, (days_to_holiday BETWEEN 1 AND 2)::INT::DOUBLE AS x_pre_holiday, snap::DOUBLE AS x_snap FROM panel_dense")
oracle("leak_check", "SELECT id, fold, origin, MIN(target_date) AS first_target, origin AS last_history FROM made_dense_weekly GROUP BY ALL")
for m in ("mean", "naive", "seasonal_naive", "drift", "moving_average_28", "seasonal_naive_364"):
    oracle(f"bench_{m}".replace("moving_average_28", "ma28"), f"SELECT id, fold, horizon, forecast FROM pred_dense_weekly WHERE method = '{m}'", "forecast", "horizon")
oracle("walk_forward", "SELECT * FROM pred_dense_weekly", "actual forecast scale", "horizon")
oracle("naive_scale", "SELECT p.id, s.scale FROM (SELECT DISTINCT id FROM panel_sparse WHERE date < (SELECT day FROM holdout_weekly)) p LEFT JOIN scale_sparse_weekly s ON s.id = p.id", "scale")
oracle("naive_scale_per_fold", "SELECT f.id, f.fold, sqrt(AVG(d.d * d.d)) AS scale FROM (SELECT p.id, f.fold, f.origin FROM folds_weekly f JOIN panel_dense p ON p.date = f.origin) f LEFT JOIN diffs_dense d ON d.id = f.id AND d.date <= f.origin GROUP BY ALL", "scale")
oracle("score_folds", "SELECT id, item_id, store_id, fold, origin, week_kind, method, kind, rmse, mae, bias, rmsse, fallback, n_days, mean_actual, unscored FROM score_dense_weekly".replace("item_id, ", "item_id, "), "rmse mae bias rmsse mean_actual")
P["cells"] = "SELECT store_id, method, AVG(rmsse) AS rmsse, AVG(mean_actual) AS lv FROM score_dense_weekly GROUP BY ALL"
oracle("rmsse_by_store", "SELECT store_id, method, rmsse, AVG(lv) OVER (PARTITION BY store_id) AS store_level, AVG(rmsse) OVER (PARTITION BY method) AS method_level FROM cells", "rmsse store_level method_level")
P["duel"] = "SELECT a.id, a.fold, a.method, a.rmsse AS m, b.method AS other, b.rmsse AS b, CASE WHEN b.rmsse > 0 THEN (b.rmsse - a.rmsse) / b.rmsse * 100 END AS gain FROM score_dense_weekly a JOIN score_dense_weekly b ON b.id = a.id AND b.fold = a.fold AND b.method <> a.method WHERE a.rmsse IS NOT NULL AND b.rmsse IS NOT NULL"
_methods = ("mean", "naive", "seasonal_naive", "drift", "moving_average_28", "seasonal_naive_364")
oracle("win_rates", "SELECT method, " + ", ".join(f"AVG((m < b)::INT::DOUBLE) FILTER (other = '{m}') AS \"{m}\"" for m in _methods) + " FROM duel GROUP BY method", " ".join(f'"{m}"' for m in _methods))
oracle("improvement_over", "SELECT method, AVG((m < b)::INT::DOUBLE) AS win_rate, AVG(gain) AS gain_mean, quantile_cont(gain, 0.25) AS gain_q1, quantile_cont(gain, 0.5) AS gain_median, quantile_cont(gain, 0.75) AS gain_q3, COUNT(*) AS n_folds, COUNT(*) FILTER (gain IS NULL) AS n_undefined FROM duel WHERE other = 'seasonal_naive' GROUP BY method", "win_rate gain_mean gain_q1 gain_median gain_q3")
oracle("summarise", "SELECT method, kind, AVG(rmsse) AS rmsse_mean, quantile_cont(rmsse, 0.5) AS rmsse_median, AVG(bias) AS bias_mean, COUNT(*) AS n_folds, COUNT(rmsse) AS n_valid, COUNT(*) FILTER (unscored) AS n_unscored, COUNT(*) FILTER (fallback) AS n_fallback, AVG(rmsse) FILTER (week_kind = 'normal') AS rmsse_normal, COUNT(rmsse) FILTER (week_kind = 'normal') AS n_normal, AVG(rmsse) FILTER (week_kind = 'holiday') AS rmsse_holiday, COUNT(rmsse) FILTER (week_kind = 'holiday') AS n_holiday FROM score_dense_weekly GROUP BY ALL", "rmsse_mean rmsse_median bias_mean rmsse_normal rmsse_holiday")
oracle("rmsse_by_horizon", "SELECT method, kind, horizon, sqrt(AVG(((forecast - actual) / NULLIF(scale, 0)) ** 2)) AS rmsse FROM pred_dense_weekly WHERE NOT closure GROUP BY ALL", "rmsse", "horizon")
oracle("bias_by_store", "SELECT store_id, " + ", ".join(f"AVG(bias) FILTER (method = '{m}') AS \"{m}\"" for m in _methods) + " FROM score_dense_weekly GROUP BY store_id", " ".join(f'"{m}"' for m in _methods))
for k in ("sparse", "mid"):
    P[f"past_{k}"] = f"SELECT * FROM panel_{k} WHERE date < (SELECT day FROM holdout_weekly)"
    for src in ("past", "panel"):
        P[f"zeros_{src}_{k}"] = f"SELECT id, COUNT(*) AS n FROM (SELECT id, date, date_diff('day', DATE '1970-01-01', date) - ROW_NUMBER() OVER (PARTITION BY id ORDER BY date) AS g FROM {src}_{k} WHERE sales = 0) GROUP BY id, g"
    P[f"stats_{k}"] = f"""SELECT s.*, CASE WHEN adi IS NULL OR cv2 IS NULL THEN 'unclassifiable' WHEN adi < 1.32 THEN CASE WHEN cv2 < 0.49 THEN 'smooth' ELSE 'erratic' END ELSE CASE WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END END AS demand_class FROM (
  SELECT p.id, item_id, store_id, COUNT(*) AS n_days, AVG(sales) AS mean_sales, AVG((sales = 0)::INT::DOUBLE) AS zero_rate, COUNT(*) / NULLIF(COUNT(*) FILTER (sales > 0), 0)::DOUBLE AS adi,
  pow(stddev_samp(sales) FILTER (sales > 0) / AVG(sales) FILTER (sales > 0), 2) AS cv2, COALESCE((SELECT MAX(n) FROM zeros_past_{k} z WHERE z.id = p.id), 0) AS max_zero_run FROM past_{k} p GROUP BY ALL) s"""
oracle("series_stats", "SELECT * FROM stats_sparse", "mean_sales zero_rate adi cv2", "max_zero_run")
oracle("demand_class", "SELECT demand_class, COUNT(*) AS n, COUNT(DISTINCT item_id) AS n_items FROM stats_mid GROUP BY demand_class")
oracle("class_table", 'SELECT item_id, MAX(demand_class) FILTER (store_id = \'A\') AS "A", MAX(demand_class) FILTER (store_id = \'N\') AS "N", MAX(demand_class) FILTER (store_id = \'R\') AS "R" FROM stats_mid GROUP BY item_id')
oracle("max_zero_run", "SELECT p.id, COALESCE(MAX(z.n), 0) AS max_zero_run FROM (SELECT DISTINCT id FROM panel_sparse) p LEFT JOIN zeros_panel_sparse z ON z.id = p.id GROUP BY p.id", "", "max_zero_run")
P["open_days"] = "SELECT id, date, event_name_1, event_name_2, CASE WHEN NOT closure THEN sales END AS y FROM panel_dense WHERE date < (SELECT day FROM holdout_weekly)"
P["baseline"] = "SELECT a.id, a.date, a.y / NULLIF(AVG(b.y), 0) AS ratio FROM open_days a CROSS JOIN (VALUES (-4), (-3), (-2), (-1), (1), (2), (3), (4)) w(n) LEFT JOIN open_days b ON b.id = a.id AND b.date = a.date + CAST(7 * w.n AS INTEGER) AND b.event_name_1 IS NULL AND b.event_name_2 IS NULL GROUP BY a.id, a.date, a.y"
P["happened"] = "SELECT date, event_name_1 AS event FROM named WHERE event_name_1 IS NOT NULL UNION ALL SELECT date, event_name_2 FROM named WHERE event_name_2 IS NOT NULL"
P["per_day"] = "SELECT h.event, h.date, o.k, AVG(b.ratio) AS ratio FROM happened h CROSS JOIN (VALUES (-2), (-1), (0), (1)) o(k) JOIN baseline b ON b.date = h.date + CAST(o.k AS INTEGER) WHERE h.date IN (SELECT date FROM open_days) GROUP BY ALL"
P["effects"] = "SELECT *, GREATEST(abs(m2 - 1), abs(m1 - 1), abs(day - 1), abs(p1 - 1)) AS max_deviation FROM (SELECT event, AVG(ratio) FILTER (k = -2) AS m2, AVG(ratio) FILTER (k = -1) AS m1, AVG(ratio) FILTER (k = 0) AS day, AVG(ratio) FILTER (k = 1) AS p1, COUNT(DISTINCT date) AS n_years FROM per_day GROUP BY event)"
oracle("event_effects", "SELECT * FROM effects", "m2 m1 day p1 max_deviation")
oracle("event_run_up", "SELECT event, GREATEST(m2, m1) AS run_up, day, max_deviation FROM effects", "run_up day max_deviation")
for k in ("dense", "mid"):
    P[f"centre_{k}"] = f"SELECT id, date, sales, CASE WHEN COUNT(sales) OVER w >= 14 THEN quantile_cont(sales, 0.5) OVER w END AS center FROM panel_{k} WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)"
    P[f"spread_{k}"] = f"SELECT *, CASE WHEN COUNT(abs(sales - center)) OVER w >= 14 THEN quantile_cont(abs(sales - center), 0.5) OVER w END AS mad FROM centre_{k} WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)"
    P[f"out_{k}"] = f"SELECT *, COALESCE(mad > 0 AND abs(sales - center) > 4.0 * 1.4826 * mad, false) AS is_outlier FROM spread_{k}"
oracle("outliers", "SELECT * FROM out_dense", "sales center mad")
oracle("outlier_counts", "SELECT id, COUNT(*) FILTER (is_outlier) AS n_outliers, COUNT(*) FILTER (is_outlier AND sales > center) AS n_spikes, COUNT(*) FILTER (is_outlier AND sales = 0) AS n_zeros FROM out_mid GROUP BY id")
P["centred"] = "SELECT id, date, sales - AVG(sales) OVER (PARTITION BY id) AS c, COUNT(*) OVER (PARTITION BY id) AS n FROM panel_dense"
P["centred_sq"] = "SELECT *, SUM(c * c) OVER (PARTITION BY id) AS ss FROM centred"
P["auto"] = "SELECT a.id, a.n, l.k AS lag, SUM(a.c * b.c) / NULLIF(MIN(a.ss), 0) AS r FROM centred_sq a CROSS JOIN range(0, 29) l(k) JOIN centred b ON b.id = a.id AND b.date = a.date - CAST(l.k AS INTEGER) GROUP BY ALL"
oracle("acf", "SELECT id, n, lag, r FROM auto", "r", "lag")
# The tail of an even number of degrees in closed form; all series here are long enough for 14.
oracle("ljung_box_q", """SELECT id, lags, q, exp(-q / 2) * (SELECT SUM(pow(q / 2, k) / factorial(CAST(k AS INTEGER))) FROM range(lags // 2) t(k)) AS p FROM (
  SELECT id, MAX(lag) AS lags, n * (n + 2) * SUM(r * r / (n - lag)) AS q FROM auto WHERE lag >= 1 AND lag <= GREATEST(1, LEAST(14, n // 5)) GROUP BY id, n)""", "q p", "lags")
for by, e in (("dow", "isodow(date) - 1"), ("month", "month(date)")):
    oracle({"dow": "weekday_profile", "month": "month_profile"}[by], f"SELECT id, store_id, {e} AS {by}, AVG(sales) AS mean_sales FROM panel_dense GROUP BY ALL", "mean_sales", by)
P["cells_dow"] = "SELECT id, isodow(date) - 1 AS dow, AVG(sales) AS m FROM panel_sparse GROUP BY ALL"
oracle("indexed_profile", 'SELECT dow, AVG(m / NULLIF(a, 0)) AS "index" FROM (SELECT *, AVG(m) OVER (PARTITION BY id) AS a FROM cells_dow) GROUP BY dow', '"index"', "dow")
oracle("snap_lift", 'SELECT id, AVG(sales) FILTER (snap = 0) AS off, AVG(sales) FILTER (snap = 1) AS "on", (AVG(sales) FILTER (snap = 1) / NULLIF(AVG(sales) FILTER (snap = 0), 0) - 1) * 100 AS lift_pct FROM panel_sparse GROUP BY id', 'off "on" lift_pct')
oracle("price_weeks", "SELECT id, CAST(date_trunc('week', date) AS DATE) AS week, MIN(sell_price) AS sell_price, AVG(sales) AS mean_sales FROM priced_sparse WHERE sell_price IS NOT NULL GROUP BY ALL", "sell_price mean_sales")
oracle("price_spells", "SELECT id, sell_price, MIN(date) AS first_day, MAX(date) AS last_day, COUNT(*) AS n_days FROM priced_dense WHERE sell_price IS NOT NULL GROUP BY ALL", "sell_price")
oracle("year_overlay", "SELECT id, year(date) AS year, dayofyear(date) AS day_of_year, level FROM (SELECT id, date, CASE WHEN COUNT(*) OVER w >= 14 THEN AVG(sales) OVER w END AS level FROM panel_dense WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) WHERE level IS NOT NULL", "level", "year day_of_year")
P["resid"] = "SELECT id, method, target_date AS date, forecast - actual AS residual FROM pred_dense_weekly WHERE horizon = 1 AND NOT closure"
oracle("residual_histogram", "SELECT r.method, CASE WHEN hi2 > lo2 THEN LEAST(floor((residual - lo2) / (hi2 - lo2) * bins), bins - 1) ELSE 0 END AS bin, COUNT(*) AS n FROM resid r JOIN (SELECT method, MIN(residual) AS lo2, MAX(residual) AS hi2, LEAST(15, GREATEST(5, COUNT(*) // 4)) AS bins FROM resid GROUP BY method) g ON g.method = r.method GROUP BY ALL", "", "bin")
P["rc"] = "SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY date) AS i, residual - AVG(residual) OVER (PARTITION BY id) AS c, COUNT(*) OVER (PARTITION BY id) AS n FROM resid WHERE method = 'seasonal_naive'"
P["rc_sq"] = "SELECT *, SUM(c * c) OVER (PARTITION BY id) AS ss FROM rc"
oracle("residual_acf", "SELECT a.id, a.n, l.k AS lag, SUM(a.c * b.c) / NULLIF(MIN(a.ss), 0) AS r FROM rc_sq a CROSS JOIN range(0, 8) l(k) JOIN rc b ON b.id = a.id AND b.i = a.i - l.k GROUP BY ALL", "r", "lag")
oracle("monthly_level", "SELECT id, method, CAST(date_trunc('month', target_date) AS DATE) AS month, AVG(actual) AS actual, AVG(forecast) AS forecast FROM pred_dense_weekly WHERE NOT closure GROUP BY ALL", "actual forecast")
oracle("weekly_totals", "SELECT * FROM week_dense_weekly", "actual forecast scale error")
oracle("weekly_bias", "SELECT method, kind, -AVG(error) AS bias, stddev_samp(error) AS sd, AVG((error > 0)::INT::DOUBLE) AS share_under, COUNT(error) AS n_weeks FROM week_dense_weekly GROUP BY ALL", "bias sd share_under")
P["taus"] = "SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS tau, unnest([1, 2, 3, 4]) AS j"
P["off"] = 'SELECT q.id, q.method, t.tau, q.o[t.j] AS "offset", q.n_calib FROM (SELECT id, method, quantile_cont(error, [0.3, 0.5, 0.7, 0.9]) AS o, COUNT(*) AS n_calib FROM week_dense_two WHERE origin < (SELECT day FROM from_two) GROUP BY ALL) q CROSS JOIN taus t'
oracle("calibrate", "SELECT * FROM off", '"offset"')
oracle("calibrate_expanding", 'SELECT q.id, q.method, q.fold, t.tau, q.o[t.j] AS "offset", q.n_calib FROM (SELECT a.id, a.method, a.fold, quantile_cont(b.error, [0.3, 0.5, 0.7, 0.9]) AS o, COUNT(*) AS n_calib FROM week_dense_two a JOIN week_dense_two b ON b.id = a.id AND b.method = a.method AND b.origin + 7 <= a.origin WHERE a.origin >= (SELECT day FROM from_two) GROUP BY ALL) q CROSS JOIN taus t', '"offset"')
P["quant"] = 'SELECT w.*, o.tau, w.forecast + o."offset" AS q FROM week_dense_two w JOIN off o ON o.id = w.id AND o.method = w.method WHERE w.origin >= (SELECT day FROM from_two)'
oracle("quantile_forecasts", "SELECT id, method, fold, tau, actual, forecast, q FROM quant", "actual forecast q")
_pin = "CASE WHEN actual >= q THEN 2 * tau * (actual - q) ELSE 2 * (1 - tau) * (q - actual) END"
P["scored"] = f"SELECT *, {_pin} AS pinball, {_pin} / NULLIF(AVG(actual) OVER (PARTITION BY id), 0) AS pinball_rel, actual <= q AS covered, GREATEST(actual - q, 0) AS shortfall, GREATEST(q - actual, 0) AS surplus FROM quant"
oracle("score_quantiles", "SELECT id, method, fold, tau, pinball, pinball_rel, covered, shortfall, surplus FROM scored", "pinball pinball_rel shortfall surplus")
oracle("summarise_quantiles", "SELECT method, kind, tau, AVG(pinball) AS pinball, AVG(pinball_rel) AS pinball_rel, AVG(covered::INT::DOUBLE) AS coverage, AVG(shortfall) AS shortfall, AVG(surplus) AS surplus, COUNT(*) AS n FROM scored GROUP BY ALL", "pinball pinball_rel coverage shortfall surplus")
_q = ((0.3, "q30"), (0.5, "q50"), (0.7, "q70"), (0.9, "q90"))
oracle("ranking_by_tau", "SELECT method, " + ", ".join(f"AVG(pinball_rel) FILTER (tau = {t}) AS {n}" for t, n in _q) + " FROM scored GROUP BY method", "q30 q50 q70 q90")
oracle("order_band", "SELECT id, method, origin, week_kind, actual, " + ", ".join(f"AVG(q) FILTER (tau = {t}) AS {n}" for t, n in _q) + ", CAST(origin + 1 AS DATE) AS day FROM quant GROUP BY ALL", "actual q30 q50 q70 q90")
P["dayerr"] = "SELECT *, actual - forecast AS error FROM pred_dense_two WHERE NOT closure AND method IN ('seasonal_naive', 'moving_average_28')"
P["dayoff"] = 'SELECT q.id, q.method, q.horizon, t.tau, q.o[t.j] AS "offset" FROM (SELECT id, method, horizon, quantile_cont(error, [0.3, 0.5, 0.7, 0.9]) AS o FROM dayerr WHERE origin < (SELECT day FROM from_two) GROUP BY ALL) q CROSS JOIN taus t'
P["dayq"] = 'SELECT e.*, o.tau, e.forecast + o."offset" AS q FROM dayerr e JOIN dayoff o ON o.id = e.id AND o.method = e.method AND o.horizon = e.horizon WHERE e.origin >= (SELECT day FROM from_two)'
oracle("daily_calibrated", "SELECT id, method, fold, horizon, tau, actual, forecast, q FROM dayq", "actual forecast q", "horizon")
P["dayscored"] = f"SELECT method, tau, {_pin} / NULLIF(AVG(actual) OVER (PARTITION BY id), 0) AS rel FROM dayq"
oracle("daily_ranking", "SELECT method, " + ", ".join(f"AVG(rel) FILTER (tau = {t}) AS {n}" for t, n in _q) + " FROM dayscored GROUP BY method", "q30 q50 q70 q90")
P["native"] = "SELECT *, CASE method WHEN 'naive' THEN 0.3::DOUBLE WHEN 'seasonal_naive' THEN 0.5::DOUBLE WHEN 'mean' THEN 0.7::DOUBLE WHEN 'drift' THEN 0.9::DOUBLE END AS tau FROM pred_dense_weekly WHERE NOT closure AND method IN ('naive', 'seasonal_naive', 'mean', 'drift')"
oracle("daily_native", "SELECT id, 'benchmarks' AS method, fold, horizon, tau, actual, forecast AS q, 'fitted' AS source FROM native", "actual q", "horizon")
oracle("weekly_native", "SELECT id, fold, 'benchmarks' AS method, tau, SUM(actual) AS actual, SUM(forecast) AS q, COUNT(*) AS n_days FROM native GROUP BY ALL", "actual q")
oracle("weekly_mae", "SELECT store_id, method, AVG(abs(error)) AS weekly_mae, COUNT(*) AS n_weeks FROM week_dense_weekly GROUP BY ALL", "weekly_mae")
P["won"] = "SELECT method, other, id, AVG(m) < AVG(b) AS better FROM duel GROUP BY ALL"
P["versus"] = "SELECT d.method, d.other, AVG((m < b)::INT::DOUBLE) AS win_rate, quantile_cont(gain, 0.5) AS gain_median, COUNT(*) AS n_folds, (SELECT COUNT(*) FILTER (better) FROM won w WHERE w.method = d.method AND w.other = d.other) AS series_won, COUNT(DISTINCT id) AS n_series FROM duel d GROUP BY d.method, d.other"
oracle("pair", "SELECT * FROM versus WHERE method = 'moving_average_28' AND other = 'seasonal_naive'", "win_rate gain_median", "series_won")
oracle("ladder", "SELECT * FROM versus WHERE (method, other) IN (('naive', 'mean'), ('seasonal_naive', 'naive'), ('moving_average_28', 'seasonal_naive'), ('seasonal_naive', 'mean'), ('moving_average_28', 'mean'))", "win_rate gain_median", "series_won")
oracle("matrix", "SELECT * FROM versus WHERE other IN ('seasonal_naive', 'moving_average_28')", "win_rate gain_median", "series_won")
oracle("scores_by_class", "SELECT c.demand_class, s.method, AVG(s.rmsse) AS rmsse, COUNT(s.rmsse) AS n_valid FROM score_mid_weekly s JOIN stats_mid c ON c.id = s.id GROUP BY ALL", "rmsse")
oracle("forecast_diff", "SELECT COUNT(*) AS n_rows, AVG((abs(a.forecast - b.forecast) <= 1e-9)::INT::DOUBLE) AS identical_share, MAX(abs(a.forecast - b.forecast)) AS max_abs_diff, MIN(a.target_date) FILTER (abs(a.forecast - b.forecast) > 1e-9) AS first_diff, MAX(a.target_date) FILTER (abs(a.forecast - b.forecast) > 1e-9) AS last_diff FROM pred_dense_weekly a JOIN pred_dense_weekly b ON b.id = a.id AND b.fold = a.fold AND b.horizon = a.horizon WHERE a.method = 'seasonal_naive' AND b.method = 'naive'", "identical_share max_abs_diff")
oracle("identity_gate", "SELECT COUNT(*) FILTER (fold >= 50) AS only_a, 0::BIGINT AS only_b, 0.0::DOUBLE AS max_abs_diff, CASE WHEN COUNT(*) FILTER (fold >= 50) > 0 THEN 'ROW MISMATCH' ELSE 'IDENTICAL' END AS verdict FROM pred_dense_weekly")
def _text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"


def _run(scores: str, cfg: Config, code: str, day: int, factor: str) -> str:
    """The fold scores of one recorded run: what describes it, written out from its config."""
    fields = json.dumps(cfg.fields(), sort_keys=True)
    alone = json.dumps(cfg.fields() | {"pool_by": "None"}, sort_keys=True)
    return f"""SELECT s.* REPLACE (rmsse * {factor} AS rmsse, rmse * {factor} AS rmse), {_text(suite_of(cfg))} AS suite, '' AS item_ids, '' AS store_ids, {_text(cfg.pool_by)} AS pool_by, {cfg.fold_step} AS fold_step,
  {cfg.n_folds} AS n_folds, 7 AS horizon, 0 AS seed, {_text(fields)} AS config_json, {_text(alone)} AS layout_json, '{code}' AS code_digest, DATE '2024-01-0{day}' AS recorded_at FROM {scores} s"""


_weekly, _dev = suite_config("weekly"), Config(n_folds=8)
_even, _some = "CASE WHEN fold % 2 = 0 THEN 0.9 ELSE 1.0 END", "CASE WHEN fold % 5 < 2 THEN 1.4 ELSE 1.0 END"
P["rec"] = "SELECT *, method || '-' || substr(sha1(method || '|' || config_json || '|' || code_digest), 1, 12) AS run_id FROM (" + " UNION ALL ".join((
    _run("score_dense_weekly", _weekly, "c1", 1, "1.0"), _run("score_dense_weekly", _weekly, "c2", 2, _even), _run("score_dense_dev", _dev, "c1", 3, "1.0"),
    _run("score_dense_weekly", replace(_weekly, pool_by="item_id"), "c2", 4, "0.95"), _run("score_dense_weekly", _weekly, "c3", 5, _even), _run("score_dense_weekly", _weekly, "c4", 6, _some),
)) + ")"
P["recbench"] = "SELECT DISTINCT ON (layout_json, id, fold, method) layout_json, id, fold, method AS other, rmsse AS b FROM rec WHERE code_digest = 'c1' AND method IN ('seasonal_naive', 'moving_average_28') AND rmsse IS NOT NULL"
P["recduel"] = "SELECT a.run_id, d.other, a.rmsse AS m, d.b, CASE WHEN d.b > 0 THEN (d.b - a.rmsse) / d.b * 100 END AS gain FROM rec a JOIN recbench d USING (layout_json, id, fold) WHERE a.method <> d.other AND a.rmsse IS NOT NULL"
P["recgain"] = "SELECT run_id, other, AVG((m < b)::INT::DOUBLE) AS win, AVG(gain) AS gmean, quantile_cont(gain, 0.25) AS q1, quantile_cont(gain, 0.5) AS q2, quantile_cont(gain, 0.75) AS q3 FROM recduel GROUP BY ALL"
P["rechead"] = """SELECT run_id, method, kind, suite, item_ids, store_ids, pool_by, fold_step, n_folds, horizon, seed, config_json, code_digest, recorded_at, COUNT(*) AS n_scored, COUNT(rmsse) AS n_valid,
  COUNT(*) FILTER (unscored) AS n_unscored, COUNT(*) FILTER (fallback) AS n_fallback, AVG(rmsse) AS rmsse_mean, quantile_cont(rmsse, 0.5) AS rmsse_median, AVG(rmsse) FILTER (week_kind = 'normal') AS rmsse_normal,
  AVG(rmsse) FILTER (week_kind = 'holiday') AS rmsse_holiday, AVG(bias) AS bias_mean FROM rec GROUP BY ALL"""
P["runs"] = """SELECT h.*, r.win AS win_vs_ref, r.gmean AS impr_mean, r.q1 AS impr_q1, r.q2 AS impr_median, r.q3 AS impr_q3, s.win AS win_vs_stress, s.q2 AS impr_median_stress, length(method) * 10.0 AS run_seconds,
  CASE WHEN code_digest <> 'c1' THEN 'refit ' || code_digest END AS note
  FROM rechead h LEFT JOIN recgain r ON r.run_id = h.run_id AND r.other = 'seasonal_naive' LEFT JOIN recgain s ON s.run_id = h.run_id AND s.other = 'moving_average_28'"""
oracle("run_rows", "SELECT * EXCLUDE (config_json, run_seconds, note) FROM runs", "rmsse_mean rmsse_median rmsse_normal rmsse_holiday bias_mean win_vs_ref impr_mean impr_q1 impr_median impr_q3 win_vs_stress impr_median_stress", "fold_step n_folds horizon seed")
oracle("fold_score_rows", "SELECT run_id, id, item_id, store_id, fold, origin, week_kind, rmsse, bias, mae, rmse, mean_actual, n_days, unscored, fallback FROM rec", "rmse mae bias rmsse mean_actual")
P["before"] = "SELECT run_id, method, config_json, recorded_at, (SELECT arg_max(p.run_id, p.recorded_at) FROM rechead p WHERE p.config_json = r.config_json AND p.method = r.method AND p.recorded_at < r.recorded_at) AS predecessor FROM rechead r"
oracle("predecessor", "SELECT * EXCLUDE (config_json) FROM before")
P["cmp"] = "SELECT p.predecessor AS run_a, p.run_id AS run_b, a.rmsse AS b, b.rmsse AS m, a.bias AS ba, b.bias AS bb, CASE WHEN a.rmsse > 0 THEN (a.rmsse - b.rmsse) / a.rmsse * 100 END AS gain FROM before p JOIN rec a ON a.run_id = p.predecessor JOIN rec b ON b.run_id = p.run_id AND b.id = a.id AND b.origin = a.origin WHERE a.rmsse IS NOT NULL AND b.rmsse IS NOT NULL"
oracle("compare_runs", """SELECT *, CASE WHEN gain_q1 = 0 AND gain_q3 = 0 AND abs(rmsse_a - rmsse_b) < 1e-12 THEN 'IDENTICAL' WHEN abs(gain_median) < 2 AND win_rate_b >= 0.35 AND win_rate_b <= 0.65 THEN 'ok' ELSE 'CHECK' END AS verdict FROM (
  SELECT run_a, run_b, COUNT(*) AS n_paired, COUNT(*) FILTER (b <= 0) AS n_undefined, AVG((m < b)::INT::DOUBLE) AS win_rate_b, AVG(b) AS rmsse_a, AVG(m) AS rmsse_b, AVG(ba) AS bias_a, AVG(bb) AS bias_b, AVG(gain) AS gain_mean,
  quantile_cont(gain, 0.25) AS gain_q1, quantile_cont(gain, 0.5) AS gain_median, quantile_cont(gain, 0.75) AS gain_q3 FROM cmp GROUP BY ALL)""", "win_rate_b rmsse_a rmsse_b bias_a bias_b gain_mean gain_q1 gain_median gain_q3")
oracle("match_runs", "SELECT n.run_id, arg_max(o.run_id, o.recorded_at) AS before FROM rechead n LEFT JOIN rechead o ON o.method = n.method AND o.n_folds = n.n_folds AND o.pool_by IS NOT DISTINCT FROM n.pool_by AND o.run_id <> n.run_id WHERE n.code_digest = 'c3' GROUP BY n.run_id")
oracle("record", """SELECT run_id, method, suite, code_digest, CASE WHEN code_digest IN ('c1', 'c2') THEN recorded_at ELSE CAST(recorded_at + INTERVAL 30 DAY AS DATE) END AS recorded_at,
  CASE code_digest WHEN 'c1' THEN 'again' WHEN 'c2' THEN 'refit c2 | again' ELSE 'again' END AS note FROM rechead""")
oracle("backfill", "SELECT run_id, method, code_digest AS code, pool_by FROM rechead WHERE code_digest <> 'c2' OR pool_by IS NOT NULL")
oracle("refresh", "SELECT run_id, method, code_digest, ((method = 'naive' AND code_digest = 'c2') OR (method = 'mean' AND code_digest = 'c1'))::BIGINT AS code_current FROM rechead")
oracle("same_config", "SELECT a.run_id AS run_a, b.run_id AS run_b FROM rechead a JOIN rechead b ON b.method = a.method AND a.run_id < b.run_id AND a.n_folds = b.n_folds")
_short = _case([(f"method = '{m}'", t) for m, t in (("mean", "MEAN"), ("naive", "NAIVE"), ("drift", "DRIFT"), ("seasonal_naive", "SN7"), ("seasonal_naive_364", "SN364"), ("moving_average_28", "MA28"))])
P["current"] = "SELECT * FROM rechead r WHERE recorded_at = (SELECT MAX(x.recorded_at) FROM rechead x WHERE x.suite IS NOT DISTINCT FROM r.suite AND x.method = r.method AND x.pool_by IS NOT DISTINCT FROM r.pool_by)"
oracle("run_labels", f"SELECT c.run_id, {_short} || CASE WHEN c.pool_by IS NULL THEN '' ELSE '·P' END AS label, c.suite, n_scored AS n, rmsse_mean AS rmsse FROM current c", "rmsse")
oracle("stage_progression", "SELECT suite, item_ids, place, stage, rmsse_mean AS value FROM current JOIN (VALUES (0::BIGINT, 'yearly', 'seasonal_naive_364', NULL), (1, 'level', 'moving_average_28', NULL), (2, 'pooled level', 'moving_average_28', 'item_id')) v(place, stage, method, pool) USING (method) WHERE pool IS NOT DISTINCT FROM pool_by", "value")
oracle("run_minutes", "SELECT suite, item_ids, pool_by, SUM(length(method) * 10.0) / 60 AS minutes FROM rechead GROUP BY ALL", "minutes")
oracle("scale_change", "SELECT a.id, a.scale AS scale_a, b.scale AS scale_b, (b.scale / a.scale - 1) * 100 AS change_pct FROM scale_dense_weekly a JOIN scale_dense_dev b USING (id)", "scale_a scale_b change_pct")
oracle("registry_top3", "SELECT suite, method, rmsse_mean, place FROM (SELECT suite, method, rmsse_mean, ROW_NUMBER() OVER (PARTITION BY suite ORDER BY rmsse_mean, method) AS place FROM rechead WHERE code_digest = 'c1') WHERE place <= 3", "rmsse_mean", "place")
oracle("registry_by_store", "SELECT suite, method, store_id, AVG(rmsse) AS rmsse, COUNT(*) AS n FROM rec WHERE code_digest = 'c1' GROUP BY ALL", "rmsse")
oracle("registry_holiday_split", "SELECT suite, method, AVG(rmsse) FILTER (week_kind = 'holiday') AS holiday, AVG(rmsse) FILTER (week_kind = 'normal') AS normal FROM rec WHERE code_digest = 'c1' GROUP BY ALL", "holiday normal")
oracle("registry_latest", "SELECT suite, method, pool_by, code_digest, run_id, recorded_at, rmsse_mean FROM current", "rmsse_mean")
oracle("stats_summary", """SELECT item_id, COUNT(*) AS n_series, MIN(mean_sales) AS least_mean, MAX(mean_sales) AS most_mean, MIN(zero_rate) AS least_zero, MAX(zero_rate) AS most_zero, COUNT(DISTINCT demand_class) AS n_classes,
  string_agg(DISTINCT demand_class, ', ' ORDER BY demand_class) AS classes FROM stats_mid GROUP BY item_id""", "least_mean most_mean least_zero most_zero")
oracle("zero_rates", "SELECT store_id, item_id, zero_rate, mean_sales, ROW_NUMBER() OVER (ORDER BY mean_sales DESC, id) AS place FROM stats_mid WHERE isfinite(adi) AND isfinite(cv2)", "zero_rate mean_sales", "place")
oracle("worst_zero_runs", "SELECT p.id, COALESCE(MAX(z.n), 0) AS max_zero_run FROM (SELECT DISTINCT id FROM panel_sparse) p LEFT JOIN zeros_panel_sparse z ON z.id = p.id GROUP BY p.id ORDER BY 2 DESC, 1 LIMIT 5", "", "max_zero_run")
oracle("tau_lines", "SELECT tau, AVG(pinball_rel) AS pinball_rel, AVG(covered::INT::DOUBLE) AS coverage FROM scored WHERE method = 'seasonal_naive' GROUP BY tau", "pinball_rel coverage")
oracle("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY ALL", "total")

# Intermittent demand: the recursion day by day, all series side by side.
P["ordered_sparse"] = "SELECT id, date, sales, ROW_NUMBER() OVER (PARTITION BY id ORDER BY date) AS k FROM panel_sparse"
P["smoothed_sparse"] = """SELECT * FROM (WITH RECURSIVE r AS (
  SELECT id, k, CASE WHEN sales > 0 THEN sales END AS z, CASE WHEN sales > 0 THEN 1.0::DOUBLE END AS p, CASE WHEN sales > 0 THEN 1.0::DOUBLE END AS d, CASE WHEN sales > 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS q FROM ordered_sparse WHERE k = 1
  UNION ALL
  SELECT o.id, o.k, CASE WHEN o.sales > 0 THEN COALESCE(r.z + 0.1::DOUBLE * (o.sales - r.z), o.sales) ELSE r.z END, CASE WHEN o.sales > 0 THEN COALESCE(r.p + 0.1::DOUBLE * (r.q - r.p), r.q) ELSE r.p END,
    COALESCE(r.d + 0.05::DOUBLE * ((o.sales > 0)::INT - r.d), CASE WHEN o.sales > 0 THEN 1 / r.q END), CASE WHEN o.sales > 0 THEN 1.0::DOUBLE ELSE r.q + 1 END
  FROM r JOIN ordered_sparse o ON o.id = r.id AND o.k = r.k + 1
) SELECT r.*, o.date FROM r JOIN ordered_sparse o USING (id, k))"""
P["rates_sparse"] = """SELECT id, date, unnest([{'method': 'croston', 'forecast': COALESCE(z / p, 0.0)}, {'method': 'croston_sba', 'forecast': COALESCE(z / p * 0.95::DOUBLE, 0.0)}, {'method': 'tsb', 'forecast': COALESCE(d * z, 0.0)}], recursive := true)
  FROM smoothed_sparse"""
P["sporadic_sparse"] = """SELECT m.id, m.item_id, m.store_id, m.fold, m.origin, m.week_kind, r.method, 'model' AS kind, m.horizon, m.target_date, m.actual, r.forecast, m.scale, m.closure, m.holiday_window, false AS fallback
  FROM made_sparse_weekly m JOIN rates_sparse r ON r.id = m.id AND r.date = m.origin"""
oracle("croston", "SELECT * FROM sporadic_sparse WHERE method <> 'tsb'", "actual forecast scale", "horizon")
oracle("tsb", "SELECT * FROM sporadic_sparse WHERE method = 'tsb'", "actual forecast scale", "horizon")
oracle("demand_routing", """SELECT method, COUNT(rmsse) AS n, AVG(rmsse) AS rmsse, AVG(mae) AS mae, AVG(bias) AS bias FROM (
  SELECT id, fold, method, CASE WHEN MIN(scale) > 0 THEN sqrt(AVG((forecast - actual) ** 2)) / MIN(scale) END AS rmsse, AVG(abs(forecast - actual)) AS mae, AVG(forecast - actual) AS bias FROM (
    SELECT * FROM pred_sparse_weekly UNION ALL BY NAME SELECT * FROM sporadic_sparse UNION ALL BY NAME
    SELECT * REPLACE ('routed' AS method) FROM (SELECT * FROM pred_sparse_weekly UNION ALL BY NAME SELECT * FROM sporadic_sparse) a SEMI JOIN (
      SELECT id, CASE demand_class WHEN 'smooth' THEN 'moving_average_28' WHEN 'intermittent' THEN 'croston_sba' WHEN 'lumpy' THEN 'tsb' ELSE 'mean' END AS method FROM stats_sparse) s ON s.id = a.id AND s.method = a.method
  ) WHERE NOT closure GROUP BY id, fold, method) GROUP BY method""", "rmsse mae bias")

# As-of join: each order line with the price of its part on the order's date, from prices that hold from their date on.
P["order_lines"] = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS order_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
P["dated_prices"] = "SELECT l_partkey, CAST(l_shipdate AS DATE) AS price_date, MIN(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY ALL"
oracle("price_as_of", "SELECT l.*, p.price_date, p.price FROM order_lines l ASOF LEFT JOIN dated_prices p ON p.l_partkey = l.l_partkey AND l.order_date >= p.price_date", "price", "l_linenumber")

# Pooled calibration: the errors of an item's series together, as ranks without interpolation.
oracle("calibrate_pooled", """SELECT t.item_id, t.method, t.fold, q.tau, (SELECT MIN(x) FROM (SELECT x, ROW_NUMBER() OVER (ORDER BY x) AS r FROM (SELECT unnest(t.errors) AS x)) WHERE r >= q.tau * len(t.errors) - 1e-9) AS "offset", len(t.errors) AS n_calib FROM (
  SELECT f.item_id, f.method, f.fold, (SELECT list(w.error) FROM week_sparse_weekly w WHERE w.error IS NOT NULL AND w.item_id = f.item_id AND w.method = f.method AND w.origin <= f.origin - 7) AS errors
  FROM (SELECT DISTINCT item_id, method, fold, origin FROM week_sparse_weekly WHERE error IS NOT NULL AND origin >= (SELECT day FROM from_weekly)) f
) t CROSS JOIN (VALUES (0.3), (0.5), (0.7), (0.9)) q(tau) WHERE len(t.errors) > 0""", '"offset" tau', "n_calib")
