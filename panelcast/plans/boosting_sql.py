"""Binning, boosting and scoring stated in SQL, as a twin of ``operators.boosting``."""

from __future__ import annotations

import math

from panelcast.operators.boosting import SUM_BITS, VALUE_BITS, Boosting
from panelcast.schema import N_LAGS

DEPTH = 3
INNER, LEAVES = (1 << DEPTH) - 1, 1 << DEPTH
_LAGS = [f"lag_{k}" for k in range(1, N_LAGS + 2)]


def known_rows(name: str, measure: str, last: int) -> str:
    """The rows to learn from: amounts with their lags as ``y, lag_*``."""
    lags = ", ".join(
        f"lag({measure}, {k}, 0) OVER w AS lag_{k}" for k in range(1, N_LAGS + 2)
    )
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
  SELECT series_id, month, {measure} AS y, {lags} FROM cells
  WINDOW w AS (PARTITION BY series_id ORDER BY month)) WHERE month <= {last})"""


def binning(name: str, rows: str, settings: Boosting) -> list[str]:
    """One row of units, scales and bin widths."""
    n_bins = settings.max_bins
    bits = f"least({VALUE_BITS}, {SUM_BITS} - (floor(log2(n)) + 1))"

    def sized(column: str) -> str:
        return f"CAST(sum(abs(floor({column} / unit + 0.5))) AS DOUBLE) / any_value(n) * any_value(unit)"

    def end(extreme: str, scale: str) -> str:
        return f"({extreme} / (abs({extreme}) + {scale}))"

    def counted(column: str) -> str:
        span = f"(max_{column} - min_{column})"
        return f"CASE WHEN {span} < {n_bins} THEN 1.0::DOUBLE ELSE {n_bins}::DOUBLE / {span} END"

    def factor(column: str) -> str:
        return (
            f"CASE WHEN {column}_to > {column}_from "
            f"THEN {n_bins}::DOUBLE / ({column}_to - {column}_from) ELSE 0::DOUBLE END"
        )

    extremes = ", ".join(
        f"{f}({c}) AS {f}_{c}"
        for c in ("series_id", "month", "y", "change")
        for f in ("min", "max")
    )
    return [
        f"""{name}_extremes AS MATERIALIZED (SELECT *, CASE WHEN big > 0
    THEN pow(2::DOUBLE, floor(log2(big)) + 1 - {bits}) ELSE 1::DOUBLE END AS unit
  FROM (SELECT *, greatest(abs(min_y), abs(max_y), abs(min_change), abs(max_change)) AS big
    FROM (SELECT count(*) AS n, {extremes} FROM (SELECT *, y - lag_1 AS change FROM {rows}))))""",
        f"""{name}_scales AS MATERIALIZED (SELECT {sized("y")} AS level_mean,
    {sized("change")} AS change_mean FROM (SELECT *, y - lag_1 AS change FROM {rows}), {name}_extremes)""",
        f"""{name} AS MATERIALIZED (SELECT *, {factor("level")} AS level_factor,
    {factor("change")} AS change_factor, {counted("series_id")} AS series_factor,
    {counted("month")} AS month_factor
  FROM (SELECT *, {end("least(min_y, 0)", "level_scale")} AS level_from,
      {end("greatest(max_y, 0)", "level_scale")} AS level_to,
      {end("least(min_change, 0)", "change_scale")} AS change_from,
      {end("greatest(max_change, 0)", "change_scale")} AS change_to
    FROM (SELECT e.*, CASE WHEN level_mean > 0 THEN level_mean ELSE unit END AS level_scale,
        CASE WHEN change_mean > 0 THEN change_mean ELSE unit END AS change_scale
      FROM {name}_extremes e, {name}_scales)))""",
    ]


def codes(settings: Boosting) -> str:
    """All features of a row as bins, given one row of binning."""

    def place(at: str, first: str, factor: str) -> str:
        inside = f"greatest(0, floor(({at} - {first}) * {factor}))"
        return f"CAST(least({settings.max_bins - 1}, {inside}) AS INTEGER)"

    out = [
        place("CAST(series_id AS DOUBLE)", "CAST(min_series_id AS DOUBLE)", "series_factor"),
        place("CAST(month AS DOUBLE)", "CAST(min_month AS DOUBLE)", "month_factor"),
    ]
    for k in range(1, N_LAGS + 1):
        lag = f"lag_{k}"
        out.append(place(f"{lag} / (abs({lag}) + level_scale)", "level_from", "level_factor"))
    for k in range(1, N_LAGS + 1):
        diff = f"(lag_{k} - lag_{k + 1})"
        out.append(place(f"{diff} / (abs({diff}) + change_scale)", "change_from", "change_factor"))
    return f"[{', '.join(out)}]"


def subsets(settings: Boosting) -> str:
    """The features that each tree may split on."""
    n, prime = 2 * N_LAGS + 2, 2_147_483_647
    return f"""subsets AS MATERIALIZED (SELECT t, f FROM (
  SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY m * m % {prime}, f) AS k FROM (
    SELECT t, f, (({settings.seed} * {settings.n_trees} + t) * {n} + f + 1) * 48271 % {prime} AS m
    FROM range({settings.n_trees}) AS a(t), range({n}) AS b(f)))
  WHERE k <= {math.ceil(settings.feature_share * n)})"""


def _shrunk(total: str, settings: Boosting) -> str:
    amount = f"CAST({total} AS DOUBLE)"
    return f"(sign({amount}) * greatest(abs({amount}) - {settings.l1!r}::DOUBLE / unit, 0::DOUBLE))"


def _explained(total: str, n: str, settings: Boosting) -> str:
    shrunk = _shrunk(total, settings)
    return f"({shrunk} * {shrunk} / ({n} + {settings.l2!r}::DOUBLE))"


def _level(level: int, settings: Boosting) -> list[str]:
    """From rows with their nodes ``at{level}``, the splits and the nodes one level below."""
    left, right = ("gl", "nl"), ("(gt - gl)", "(nt - nl)")
    gain = f"{_explained(*left, settings)} + {_explained(*right, settings)}"
    least = settings.least_rows
    return [
        f"""sums{level} AS (SELECT node, f, codes[f + 1] AS c, sum(r) AS g, count(*) AS n, any_value(unit) AS unit
    FROM at{level} JOIN subsets USING (t) GROUP BY node, f, c)""",
        f"""running{level} AS (SELECT node, f, c, unit, sum(g) OVER s AS gl, sum(n) OVER s AS nl,
    sum(g) OVER (PARTITION BY node, f) AS gt, sum(n) OVER (PARTITION BY node, f) AS nt
    FROM sums{level} WINDOW s AS (PARTITION BY node, f ORDER BY c))""",
        f"""splits{level} AS (SELECT node, f, c FROM (SELECT *,
      row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, c) AS place
    FROM (SELECT *, {gain} AS gain, {_explained("gt", "nt", settings)} AS own FROM running{level}
      WHERE nl >= {least} AND nt - nl >= {least}) WHERE gain > own) WHERE place = 1)""",
        f"""at{level + 1} AS (SELECT a.* EXCLUDE (node), 2 * a.node + 1
      + CASE WHEN s.f IS NOT NULL AND codes[s.f + 1] > s.c THEN 1 ELSE 0 END AS node
    FROM at{level} a LEFT JOIN splits{level} s USING (node))""",
    ]


def boosted(name: str, rows: str, bins: str, settings: Boosting) -> str:
    """Trees as rows with ``sf, sb, v`` (features, bins, leaf values) of a recursion over trees,
    whose other rows are the rows learnt from."""
    levels = ",\n  ".join(part for k in range(DEPTH) for part in _level(k, settings))
    every_split = " UNION ALL ".join(f"SELECT * FROM splits{k}" for k in range(DEPTH))
    value = (
        f"CAST(floor({settings.learning_rate!r}::DOUBLE * {_shrunk('sum(r)', settings)} "
        f"/ (count(*) + {settings.l2!r}::DOUBLE) + 0.5) AS BIGINT)"
    ).replace("/ unit", "/ any_value(unit)")
    return f"""{name}_rows AS MATERIALIZED (SELECT {codes(settings)} AS codes,
    CAST(floor(y / unit + 0.5) AS BIGINT) AS y, unit FROM {rows}, {bins}),
{name}_base AS MATERIALIZED (
  SELECT CAST(floor(CAST(sum(y) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS base FROM {name}_rows),
{name} AS (
  SELECT CAST(0 AS BIGINT) AS t, row_number() OVER () AS rid, codes, y, base AS p, unit,
    CAST(NULL AS BIGINT[]) AS sf, CAST(NULL AS INTEGER[]) AS sb, CAST(NULL AS BIGINT[]) AS v
  FROM {name}_rows, {name}_base
  UNION ALL (
  WITH at0 AS (SELECT t, rid, codes, y, p, unit, CAST(y - p AS BIGINT) AS r, 0 AS node FROM {name}
    WHERE rid IS NOT NULL AND t < {settings.n_trees}),
  {levels},
  leaves AS (SELECT node, {value} AS value FROM at{DEPTH} GROUP BY node),
  every_split AS ({every_split}),
  tree AS (SELECT (SELECT list(coalesce(f, 0) ORDER BY i) FROM range({INNER}) AS g(i)
      LEFT JOIN every_split ON node = i) AS sf,
    (SELECT list(CAST(coalesce(c, {settings.max_bins}) AS INTEGER) ORDER BY i)
      FROM range({INNER}) AS g(i) LEFT JOIN every_split ON node = i) AS sb,
    (SELECT list(coalesce(value, 0) ORDER BY i) FROM range({LEAVES}) AS g(i)
      LEFT JOIN leaves ON node = i + {INNER}) AS v)
  SELECT t + 1, rid, codes, y, p + value, unit, NULL, NULL, NULL FROM at{DEPTH} JOIN leaves USING (node)
  UNION ALL
  SELECT (SELECT max(t) + 1 FROM at0), NULL, NULL, NULL, NULL, NULL, sf, sb, v FROM tree
    WHERE EXISTS (SELECT 1 FROM at0))),
{name}_trees AS MATERIALIZED (SELECT sf, sb, v FROM {name} WHERE rid IS NULL)"""


def scored(rows: str, trees: str, bins: str, settings: Boosting) -> str:
    """``rows`` with ``y_pred``: all trees walked by every row."""
    nodes = "0"
    walk = []
    for level in range(DEPTH):
        walk.append((f"n{level + 1}", nodes))
        nodes = f"n{level + 1}"
    inner = f"SELECT r.*, sf, sb, v FROM coded r, {trees}_trees"
    for column, at in walk:
        step = f"2 * {at} + 1 + CASE WHEN codes[sf[{at} + 1] + 1] > sb[{at} + 1] THEN 1 ELSE 0 END"
        inner = f"SELECT *, {step} AS {column} FROM ({inner})"
    lags = ", ".join(_LAGS)
    return f"""(WITH coded AS (SELECT r.*, {codes(settings)} AS codes, unit FROM {rows} r, {bins})
  SELECT series_id, month, {lags},
    (any_value(base) + CAST(sum(v[n{DEPTH} - {INNER} + 1]) AS BIGINT)) * any_value(unit) AS y_pred
  FROM ({inner}), {trees}_base GROUP BY ALL)"""


def _shift(value: str) -> str:
    """The lags of the month after a row."""
    return f"{value} AS lag_1, " + ", ".join(f"lag_{k} AS lag_{k + 1}" for k in range(1, N_LAGS + 1))


def rolled_once(name: str, measure: str, last: int, horizon: int, settings: Boosting) -> list[str]:
    """``name``: the months ahead, all from trees fitted on the known months."""
    rows, bins, trees = f"{name}_known", f"{name}_bins", f"{name}_fit"
    asked = f"(SELECT series_id, month + 1 AS month, {_shift('y')} FROM {name}_state)"
    ahead = scored(asked, trees, bins, settings)
    return [
        known_rows(rows, measure, last),
        *binning(bins, rows, settings),
        boosted(trees, rows, bins, settings),
        f"""{name}_state AS (
  SELECT series_id, month, y, {", ".join(_LAGS)} FROM {rows} WHERE month = {last}
  UNION ALL
  SELECT series_id, month, y_pred, {", ".join(_LAGS)} FROM {ahead}
  WHERE month <= {last + horizon})""",
        f"""{name} AS (SELECT series_id, CAST(month AS INTEGER) AS month, y AS y_pred
  FROM {name}_state WHERE month > {last})""",
    ]


def rolled_each_step(
    name: str, measure: str, last: int, horizon: int, settings: Boosting
) -> list[str]:
    """``name``: the months ahead, each from trees fitted on all months before it."""
    bins = f"{name}_bins"
    columns = ", ".join(_LAGS)
    parts = [known_rows(f"{name}_known0", measure, last)]
    parts += binning(bins, f"{name}_known0", settings)
    for step in range(1, horizon + 1):
        rows, trees = f"{name}_known{step - 1}", f"{name}_fit{step}"
        asked = f"(SELECT series_id, month + 1 AS month, {_shift('y')} FROM {rows} WHERE month = {last + step - 1})"
        parts.append(boosted(trees, rows, bins, settings))
        parts.append(
            f"""{name}_step{step} AS MATERIALIZED (
  SELECT series_id, CAST(month AS INTEGER) AS month, y_pred AS y, {columns}
  FROM {scored(asked, trees, bins, settings)})"""
        )
        parts.append(
            f"""{name}_known{step} AS MATERIALIZED (
  SELECT series_id, month, y, {columns} FROM {rows}
  UNION ALL SELECT series_id, month, y, {columns} FROM {name}_step{step})"""
        )
    steps = " UNION ALL ".join(
        f"SELECT series_id, month, y AS y_pred FROM {name}_step{k}" for k in range(1, horizon + 1)
    )
    return [*parts, f"{name} AS ({steps})"]
