"""The same queries in SQL, over the same tables."""

from __future__ import annotations

from panelcast.operators.boosting import Boosting
from panelcast.operators.origins import FRACTION
from panelcast.plans import boosting_sql

# Fixed values of the test tables and their clock.
CURRENT = 79
LAST = 78
N_MONTHS = 80
BEFORE_PAUSE = 71
HORIZON = 6
N_LAGS = 11
N_TREES = 20
BOOSTING = Boosting(n_trees=N_TREES, learning_rate=0.1)

_HISTORY = """history AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS periode,
         c_mktsegment AS bu, o_orderpriority AS ctt, l_linestatus AS ope, l_returnflag AS pthrough,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))
              AS DECIMAL(18,4)) AS ca,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (0.20 - CAST(l_discount AS DECIMAL(18,2)))
              AS DECIMAL(18,4)) AS mg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_DATED = """dated AS (
  SELECT *, CAST(strptime(periode || '-01', '%Y-%m-%d') AS DATE) AS period FROM history)"""
_SUMS = """sums AS (
  SELECT bu, ctt, ope, pthrough, period,
         coalesce(CAST(sum(ca) AS DOUBLE), 0) AS ca, coalesce(CAST(sum(mg) AS DOUBLE), 0) AS mg
  FROM dated GROUP BY bu, ctt, ope, pthrough, period)"""
_DIMS = "dims AS (\n" + "\n  UNION ALL\n".join(
    f"""  SELECT '{k}' AS dim, {k} AS value,
         CAST(row_number() OVER (ORDER BY {k}) - 1 AS INTEGER) AS ord
  FROM (SELECT DISTINCT {k} FROM history)"""
    for k in ("bu", "ctt", "ope", "pthrough")
) + ")"
_CALENDAR = """calendar AS (
  SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS month
  FROM (SELECT DISTINCT period FROM dated))"""
_CATALOG = """catalog AS (
  SELECT CAST(row_number() OVER (ORDER BY b.ord, c.ord, o.ord, p.ord) - 1 AS BIGINT) AS series_id,
         b.value AS bu, c.value AS ctt, o.value AS ope, p.value AS pthrough
  FROM (SELECT * FROM dims WHERE dim = 'bu') b CROSS JOIN (SELECT * FROM dims WHERE dim = 'ctt') c
  CROSS JOIN (SELECT * FROM dims WHERE dim = 'ope') o
  CROSS JOIN (SELECT * FROM dims WHERE dim = 'pthrough') p)"""
_CELLS = """cells AS (
  SELECT s.series_id, c.month, f.ca AS ca_raw, coalesce(f.ca, 0) AS ca, coalesce(f.mg, 0) AS mg
  FROM catalog s CROSS JOIN calendar c
  LEFT JOIN sums f ON f.bu = s.bu AND f.ctt = s.ctt AND f.ope = s.ope
       AND f.pthrough = s.pthrough AND f.period = c.period)"""
_LAGGED = "lagged AS (\n  SELECT series_id, month, ca, " + ", ".join(
    f"lag(ca, {k}, 0) OVER w AS lag_{k}" for k in range(1, N_LAGS + 2)
) + "\n  FROM cells WINDOW w AS (PARTITION BY series_id ORDER BY month))"
_BASE = [_HISTORY, _DATED, _SUMS, _DIMS, _CALENDAR, _CATALOG, _CELLS]

_LAGS = ", ".join(f"lag_{k}" for k in range(1, N_LAGS + 1))
_DIFFS = ", ".join(f"lag_{k} - lag_{k + 1} AS diff_{k}" for k in range(1, N_LAGS + 1))


def _roll(name: str, measure: str, last: int) -> str:
    """Fixed-weight recursion over the two latest values of every series."""
    return f"""{name}_state AS (
  SELECT a.series_id, {last} AS month, a.{measure} AS y, b.{measure} AS before
  FROM cells a JOIN cells b ON a.series_id = b.series_id
  WHERE a.month = {last} AND b.month = {last - 1}
  UNION ALL
  SELECT series_id, month + 1, 0.5 * y + 0.5 * before, y
  FROM {name}_state WHERE month < {last + HORIZON}),
{name} AS (
  SELECT series_id, CAST(month AS INTEGER) AS month, y AS y_pred
  FROM {name}_state WHERE month > {last})"""


def _spine(name: str, last: int) -> str:
    return f"""{name} AS (
  SELECT month, last_day(period) AS period_end FROM calendar WHERE month <= {last}
  UNION ALL
  SELECT CAST(month + h AS INTEGER), last_day(CAST(period + to_months(CAST(h AS INTEGER)) AS DATE))
  FROM calendar, range(1, {HORIZON + 1}) AS ahead(h) WHERE month = {last})"""


def _outlook(name: str, last: int, trees: bool = False) -> list[str]:
    """Both measures, actual and predicted, under the business keys; by fixed weights, or by
    trees fitted once."""
    if trees:
        predicted = [boosting_sql.subsets(BOOSTING)]
        for m in ("ca", "mg"):
            predicted += boosting_sql.rolled_once(f"{name}_{m}", m, last, HORIZON, BOOSTING)
    else:
        predicted = [_roll(f"{name}_{m}", m, last) for m in ("ca", "mg")]
    return [
        *predicted,
        _spine(f"{name}_spine", last),
        f"""{name}_long AS (
  SELECT series_id, month, ca, CAST(NULL AS DOUBLE) AS ca_pred, mg, CAST(NULL AS DOUBLE) AS mg_pred
  FROM cells WHERE month <= {last}
  UNION ALL
  SELECT series_id, month, NULL, c.y_pred, NULL, m.y_pred
  FROM {name}_ca c JOIN {name}_mg m USING (series_id, month)),
{name} AS (
  SELECT l.month, period_end, bu, ctt, ope, pthrough, ca, ca_pred, mg, mg_pred
  FROM {name}_long l JOIN {name}_spine USING (month) JOIN catalog USING (series_id))""",
    ]


# Four cut-offs, half a year apart, the last one half a year before the last complete month.
_ORIGINS = f"""origin_state AS (
  SELECT a.month AS origin, a.series_id, a.month, a.ca AS y, b.ca AS before
  FROM cells a JOIN cells b ON a.series_id = b.series_id AND b.month = a.month - 1
  WHERE a.month IN ({", ".join(str(LAST - HORIZON * k) for k in range(1, 5))})
  UNION ALL
  SELECT origin, series_id, month + 1, 0.5 * y + 0.5 * before, y
  FROM origin_state WHERE month < origin + {HORIZON}),
judged AS (
  SELECT CAST(origin AS INTEGER) AS origin, series_id, CAST(s.month AS INTEGER) AS month,
         CAST(s.month - origin AS INTEGER) AS lead, c.ca AS y, s.y AS y_pred
  FROM origin_state s JOIN cells c USING (series_id, month) WHERE s.month > origin),
wrong AS (
  SELECT lead, count(*) AS n_cells, max(abs(y_pred - y)) AS worst_error,
         CAST(sum(CAST(floor((y_pred - y) * {FRACTION} + 0.5) AS HUGEINT)) AS DOUBLE) AS errors,
         CAST(sum(CAST(floor(abs(y_pred - y) * {FRACTION} + 0.5) AS HUGEINT)) AS DOUBLE) AS abs_errors,
         CAST(sum(CAST(floor(abs(y) * {FRACTION} + 0.5) AS HUGEINT)) AS DOUBLE) AS amounts
  FROM judged GROUP BY lead)"""


def _with(parts: list[str], select: str) -> str:
    recursive = any("_state AS (" in part or "UNION ALL (" in part for part in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


_OUTLOOK = _BASE + _outlook("fresh", LAST)
_BOTH = _OUTLOOK + _outlook("former", LAST - 1)
_SPLIT = _BASE + [
    _roll("rolled", "ca", LAST),
    f"""split AS (
  SELECT series_id, month, ca, CAST(NULL AS DOUBLE) AS ca_pred FROM cells WHERE month <= {LAST}
  UNION ALL SELECT series_id, month, NULL, y_pred FROM rolled)""",
]
_REPLACED = f"""SELECT * FROM former WHERE month < {CURRENT}
UNION ALL SELECT * FROM fresh WHERE month >= {CURRENT}"""
_FACTS = "CAST(ca AS DOUBLE) AS ca, CAST(mg AS DOUBLE) AS mg"
_K = "bu, ctt, ope, pthrough"
_FIRST = " AND ".join(
    f"{k} = (SELECT value FROM dims WHERE dim = '{k}' AND ord = 0)"
    for k in ("bu", "ctt", "ope", "pthrough")
)


def statements() -> dict[str, str]:
    history = [_HISTORY]
    dated = [_HISTORY, _DATED]
    calendar = dated + [_CALENDAR]
    lagged = _BASE + [_LAGGED]
    wide = ", ".join(
        f"sum(CASE WHEN month = {m} THEN ca ELSE 0 END) AS m{m}" for m in range(N_MONTHS)
    )
    return {
        "scan_history": _with(history, f"SELECT periode, {_K}, {_FACTS} FROM history"),
        "scan_dimensions": _with([_HISTORY, _DIMS], "SELECT dim, value, ord FROM dims"),
        "rename_columns": _with(
            history,
            f"SELECT periode AS period_label, {_K}, CAST(ca AS DOUBLE) AS ca_mois, "
            "CAST(mg AS DOUBLE) AS mg_mois FROM history",
        ),
        "drop_columns": _with(
            history, f"SELECT periode, {_K}, CAST(ca AS DOUBLE) AS ca FROM history"
        ),
        "parse_period": _with(dated, "SELECT DISTINCT periode, period FROM dated"),
        "month_bounds": _with(
            dated,
            "SELECT DISTINCT period, CAST(date_trunc('month', period) AS DATE) AS first_day, "
            "last_day(period) AS last_day FROM dated",
        ),
        "distinct_periods": _with(dated, "SELECT DISTINCT period FROM dated"),
        "distinct_series": _with(history, f"SELECT DISTINCT {_K} FROM history"),
        "count_distinct_periods": _with(
            dated, "SELECT count(DISTINCT period) AS n_periods FROM dated"
        ),
        "month_calendar": _with(calendar, "SELECT period, month FROM calendar"),
        "month_spine": _with(calendar + [_spine("spine", LAST)], "SELECT * FROM spine"),
        "horizon_bounds": _with(
            calendar
            + [
                """bound AS (
  SELECT CAST(coalesce(max(CASE WHEN period = DATE '2001-08-01' THEN month END), max(month) + 1)
              AS INTEGER) AS c FROM calendar)"""
            ],
            "SELECT c AS current_month, CAST(c - 1 AS INTEGER) AS last_month, "
            f"CAST(c - 1 + {HORIZON} AS INTEGER) AS last_predicted FROM bound",
        ),
        "cross_join": _with(
            [_HISTORY, _DIMS],
            "SELECT b.value AS bu, c.value AS ctt FROM (SELECT * FROM dims WHERE dim = 'bu') b "
            "CROSS JOIN (SELECT * FROM dims WHERE dim = 'ctt') c",
        ),
        "series_catalog": _with(
            [_HISTORY, _DIMS, _CATALOG], f"SELECT series_id, {_K} FROM catalog"
        ),
        "filter_series": _with(
            [_HISTORY, _DIMS], f"SELECT periode, {_FACTS} FROM history WHERE {_FIRST}"
        ),
        "orphan_facts": _with(
            history, f"SELECT periode, {_K}, {_FACTS} FROM history WHERE bu = 'BUILDING'"
        ),
        "merged_sums": _with(dated + [_SUMS], f"SELECT {_K}, period, ca, mg FROM sums"),
        "monthly_sums": _with(dated + [_SUMS], f"SELECT {_K}, period, ca, mg FROM sums"),
        "calendar_left_join": _with(
            [_HISTORY, _DATED, _SUMS, _DIMS, _CALENDAR],
            "SELECT c.month, c.period, coalesce(s.ca, 0) AS ca FROM calendar c "
            f"LEFT JOIN (SELECT * FROM sums WHERE {_FIRST}) s ON s.period = c.period",
        ),
        "zero_grid": _with(
            _BASE,
            "SELECT series_id, month, CAST(0 AS DOUBLE) AS y FROM catalog CROSS JOIN calendar",
        ),
        "dense_grid": _with(_BASE, "SELECT series_id, month, ca, mg FROM cells"),
        "zero_fill": _with(_BASE, "SELECT series_id, month, ca_raw, ca FROM cells"),
        "grid_shape": _with(
            _BASE,
            "SELECT count(DISTINCT series_id) AS n_series, count(DISTINCT month) AS n_months, "
            "count(*) AS n_cells FROM cells",
        ),
        "pivot_months": _with(_BASE, f"SELECT series_id, {wide} FROM cells GROUP BY series_id"),
        "unpivot_months": _with(_BASE, "SELECT series_id, month, ca FROM cells"),
        "sort_long": _with(
            _BASE, "SELECT month, series_id, ca FROM cells ORDER BY month, series_id"
        ),
        "lag_features": _with(lagged, f"SELECT series_id, month, {_LAGS} FROM lagged"),
        "diff_features": _with(lagged, f"SELECT series_id, month, {_DIFFS} FROM lagged"),
        "feature_frame": _with(
            lagged, f"SELECT series_id, month, ca, {_LAGS}, {_DIFFS} FROM lagged"
        ),
        "drop_incomplete_months": _with(
            _BASE, f"SELECT series_id, month, ca, mg FROM cells WHERE month < {CURRENT}"
        ),
        "train_score_split": _with(
            _BASE,
            f"SELECT series_id, month, CASE WHEN month < {LAST} THEN 'train' ELSE 'score' END "
            f"AS split FROM cells WHERE month <= {LAST}",
        ),
        "scoring_frame": _with(
            _BASE,
            f"SELECT series_id, CAST({LAST + 1} AS INTEGER) AS month, CAST(0 AS DOUBLE) AS y "
            "FROM catalog",
        ),
        "union_by_name": _with(
            lagged,
            f"SELECT series_id, month, ca AS y, lag_1 FROM lagged WHERE month < {CURRENT} "
            f"UNION ALL SELECT series_id, CAST({LAST + 1} AS INTEGER), 0, NULL FROM catalog",
        ),
        "assemble_features": _with(
            lagged,
            f"SELECT series_id, month, CAST({2 * N_LAGS + 2} AS INTEGER) AS n_features, "
            "CAST(series_id AS DOUBLE) AS f_series_id, CAST(month AS DOUBLE) AS f_month, "
            + ", ".join(f"CAST(lag_{k} AS DOUBLE) AS f_lag_{k}" for k in range(1, N_LAGS + 1))
            + ", "
            + ", ".join(
                f"CAST(lag_{k} - lag_{k + 1} AS DOUBLE) AS f_diff_{k}"
                for k in range(1, N_LAGS + 1)
            )
            + f" FROM lagged WHERE month <= {LAST}",
        ),
        "recursive_predict_fixed": _with(
            _BASE + [_roll("rolled", "ca", LAST)], "SELECT series_id, month, y_pred FROM rolled"
        ),
        "rolling_origins": _with(_BASE + [_ORIGINS], "SELECT * FROM judged"),
        "origin_errors": _with(
            _BASE + [_ORIGINS],
            f"SELECT lead, n_cells, errors / n_cells / {FRACTION} AS mean_error, "
            f"abs_errors / n_cells / {FRACTION} AS mean_abs_error, worst_error, "
            "CASE WHEN amounts > 0 THEN abs_errors / amounts END AS abs_error_share FROM wrong",
        ),
        "fit_pooled_model": _with(
            _BASE,
            f"SELECT CAST({N_TREES} AS INTEGER) AS n_trees, "
            f"CAST({2 * N_LAGS + 2} AS INTEGER) AS n_features, count(*) AS n_train, "
            "min(month) AS first_month, max(month) AS last_month, "
            f"count(*) FILTER (WHERE ca != 0) AS n_not_zero FROM cells WHERE month <= {LAST}",
        ),
        "split_actual_predicted": _with(_SPLIT, "SELECT * FROM split"),
        "future_slice": _with(_SPLIT, f"SELECT * FROM split WHERE month >= {CURRENT}"),
        "last_horizon_slice": _with(
            _SPLIT, f"SELECT * FROM split WHERE month = {LAST + HORIZON}"
        ),
        "attach_period": _with(
            _BASE + [_spine("spine", LAST)],
            "SELECT series_id, month, period_end, ca FROM cells LEFT JOIN spine USING (month)",
        ),
        "relabel_series": _with(
            _OUTLOOK, f"SELECT month, period_end, {_K}, ca, ca_pred FROM fresh"
        ),
        "join_measures": _with(_OUTLOOK, "SELECT * FROM fresh"),
        "publish_replace_slice": _with(_BOTH, _REPLACED),
        "publish_partitions": _with(_BOTH, _REPLACED),
        "publish_snapshot": _with(_BOTH, _REPLACED),
        "publish_after_pause": _with(
            _OUTLOOK + _outlook("former", BEFORE_PAUSE),
            f"SELECT * FROM former WHERE month <= {BEFORE_PAUSE + HORIZON} "
            f"UNION ALL SELECT * FROM fresh WHERE month > {BEFORE_PAUSE + HORIZON}",
        ),
        "predicted_cells": _with(
            _BASE,
            f"SELECT measure, series_id, CAST({LAST} + h AS INTEGER) AS month, TRUE AS is_finite "
            f"FROM catalog, range(1, {HORIZON + 1}) AS ahead(h), "
            "(VALUES ('ca'), ('mg')) AS m(measure)",
        ),
        "end_to_end_cells": _with(
            _OUTLOOK,
            f"SELECT month, period_end, {_K}, ca, mg, month > {LAST} AS ca_predicted, "
            f"month > {LAST} AS mg_predicted FROM fresh",
        ),
        "score_month": _with(
            _BASE + [boosting_sql.subsets(BOOSTING)]
            + boosting_sql.rolled_once("ahead", "ca", LAST, 1, BOOSTING),
            "SELECT series_id, month, y_pred FROM ahead",
        ),
        "recursive_predict": _with(
            _BASE + [boosting_sql.subsets(BOOSTING)]
            + boosting_sql.rolled_each_step("ahead", "ca", LAST, HORIZON, BOOSTING),
            "SELECT series_id, month, y_pred FROM ahead",
        ),
        "predict_all_measures": _with(
            _BASE + _outlook("trees", LAST, trees=True),
            "SELECT 'ca' AS measure, series_id, month, y_pred FROM trees_ca "
            "UNION ALL SELECT 'mg', series_id, month, y_pred FROM trees_mg",
        ),
        "end_to_end": _with(_BASE + _outlook("trees", LAST, trees=True), "SELECT * FROM trees"),
        "ingest_counts": "SELECT TRUE AS each_once, CAST(0 AS BIGINT) AS last_batch, "
        "TRUE AS all_sized",
        "export_csv": _with(
            _OUTLOOK,
            'SELECT month AS "Month", period_end AS periode, bu, ctt, ope, '
            'pthrough AS "pthrough ?", ca AS "ca mois", ca_pred AS "Forecast CA Month", '
            'mg AS "mg mois", mg_pred AS "Forecast Mg Month" FROM fresh',
        ),
        "ingest_drop": _with(history, f"SELECT periode, {_K}, {_FACTS} FROM history"),
    }
