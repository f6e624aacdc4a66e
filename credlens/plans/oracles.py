"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..operators.profile import ROLES
from . import config

KEYS = {"events": "ts, event_id", "wide": "ts, event_id", "orders": "o_orderdate, o_orderkey", "lineitem": "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"}
SMOOTH = ["normalized_mean_abs_diff", "diff_cv", "second_diff_std_ratio", "low_rolling_variance_rate", "pct_change_std"]
TIMESERIES = ["acf_lag1", "acf_lag2", "acf_lag12", "sign_change_rate", "trend_strength", "high_order_acf_max"]
DRIFT = ["mean_shift_ratio", "variance_shift_ratio", "rolling_slope_ratio", "cusum_range", "sign_imbalance"]
CHANGEPOINT = ["best_window_mean_shift_ratio", "best_window_index", "cusum_ratio", "cusum_index", "page_hinkley_ratio", "page_hinkley_index", "likely_changepoint_index"]
DIGIT = ["integer_rate", "dominant_decimal_place_rate", "dominant_last_digit_rate", "digit_length_diversity", "rounded_0_05_rate", "duplicate_rate", "numeric_kind"]
OUTLIER = ["z_outlier_rate", "iqr_outlier_rate", "variation_cv"]
SAMPLING = ["duplicate_timestamp_ratio", "interval_cv", "break_count", "estimated_missing_slots", "longest_missing_run"]
CORRELATION = ["pair_count", "average_abs_pearson", "max_abs_correlation", "high_pair_count"]


def up(v: str, a: float, b: float, most: float) -> str:
    return f"(greatest(0.0, least(1.0, ({v} - {a}) / ({b} - {a}))) * {most})"


def down(v: str, a: float, b: float, most: float) -> str:
    return f"(greatest(0.0, least(1.0, ({a} - {v}) / ({a} - {b}))) * {most})"


def series(table: str, columns: list[str]) -> str:
    """s: series, i, n, x, mean, sd, lo, hi."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS series, CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {KEYS[table]}) - 1 AS i FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    w = "(PARTITION BY series)"
    return f"WITH s AS (SELECT series, i, x, count(*) OVER {w} AS n, avg(x) OVER {w} AS mean, stddev_pop(x) OVER {w} AS sd, min(x) OVER {w} AS lo, max(x) OVER {w} AS hi FROM ({parts}))"


def result(metrics: list[str], penalties: list[str], source: str = "m") -> str:
    return f"SELECT series AS \"column\", n, round(greatest(0.0, least(100.0, 100 - ({' + '.join(penalties)}))), 6) AS score, " + ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in metrics) + f" FROM {source}"


def smooth(table: str, columns: list[str], penalties_only: bool = False) -> str:
    return f"""{series(table, columns)},
d AS (SELECT *, x - lag(x) OVER w AS d, CASE WHEN lag(x) OVER w <> 0 THEN x / lag(x) OVER w - 1 END AS change,
        round(CASE WHEN i >= 6 THEN var_samp(x) OVER (PARTITION BY series ORDER BY i ROWS 6 PRECEDING) END, 12) AS variance
      FROM s WINDOW w AS (PARTITION BY series ORDER BY i)),
dd AS (SELECT *, d - lag(d) OVER (PARTITION BY series ORDER BY i) AS dd FROM d),
q AS (SELECT series, quantile_cont(variance, 0.2) AS q FROM dd GROUP BY series),
m AS (SELECT series, any_value(n) AS n, any_value(hi) - any_value(lo) AS range, avg(abs(d)) / (any_value(hi) - any_value(lo)) AS normalized_mean_abs_diff,
        stddev_samp(d) / (abs(avg(d)) + 1e-9) AS diff_cv, stddev_samp(dd) / (any_value(hi) - any_value(lo)) AS second_diff_std_ratio,
        avg(CAST(variance < q AS INT)) AS low_rolling_variance_rate, stddev_samp(change) AS pct_change_std FROM dd JOIN q USING (series) GROUP BY series)
""" + result(SMOOTH, [down("normalized_mean_abs_diff", 0.025, 0, 28), down("diff_cv", 0.35, 0, 24), down("second_diff_std_ratio", 0.001, 0, 24), up("low_rolling_variance_rate", 0.45, 1, 16), down("pct_change_std", 0.01, 0, 12)])


def timeseries(table: str, columns: list[str]) -> str:
    lags = ", ".join(f"(x - mean) * (lag(x, {k}) OVER w - mean) AS c{k}" for k in range(1, 13))
    acf = ", ".join(f"sum(c{k}) / sum((x - mean) * (x - mean)) AS acf_lag{k}" for k in range(1, 13))
    return f"""{series(table, columns)},
d AS (SELECT *, x - lag(x) OVER w AS d, {lags} FROM s WINDOW w AS (PARTITION BY series ORDER BY i)),
t AS (SELECT *, CASE WHEN i >= 2 THEN CAST(sign(d) <> sign(lag(d) OVER (PARTITION BY series ORDER BY i)) AS INT) END AS turn FROM d),
a AS (SELECT series, any_value(n) AS n, {acf}, sum(turn) / (any_value(n) - 2) AS sign_change_rate, abs(corr(i, x)) AS trend_strength FROM t GROUP BY series),
m AS (SELECT *, greatest({", ".join(f"abs(acf_lag{k})" for k in range(2, 13))}) AS high_order_acf_max FROM a)
""" + result(TIMESERIES, [up("acf_lag1", 0.98, 1, 22), down("acf_lag1", -0.2, -1, 10), down("sign_change_rate", 0.08, 0, 20), f"least({up('trend_strength', 0.97, 1, 18)}, {down('sign_change_rate', 0.18, 0, 18)})", down("high_order_acf_max", 0.05, 0, 10)])


def drift(table: str, columns: list[str]) -> str:
    return f"""{series(table, columns)},
r AS (SELECT *, CASE WHEN i >= 19 THEN avg(x) OVER (PARTITION BY series ORDER BY i ROWS 19 PRECEDING) END AS rolling, x - lag(x) OVER w AS d,
        sum(x - mean) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING) AS cusum, greatest(5, n // 5) AS w, greatest(hi - lo, sd, 1e-9) AS scale
      FROM s WINDOW w AS (PARTITION BY series ORDER BY i)),
m AS (SELECT series, any_value(n) AS n, abs(avg(x) FILTER (i >= n - w) - avg(x) FILTER (i < w)) / any_value(scale) AS mean_shift_ratio,
        abs(stddev_pop(x) FILTER (i >= n - w) - stddev_pop(x) FILTER (i < w)) / any_value(sd) AS variance_shift_ratio,
        abs(regr_slope(rolling, i)) * (count(rolling) - 1) / any_value(scale) AS rolling_slope_ratio,
        (max(cusum) - min(cusum)) / (any_value(sd) * any_value(n)) AS cusum_range, abs(avg(sign(d)) FILTER (d <> 0)) AS sign_imbalance FROM r GROUP BY series)
""" + result(DRIFT, [up("mean_shift_ratio", 0.35, 1, 30), up("rolling_slope_ratio", 0.30, 1, 25), up("cusum_range", 0.18, 0.45, 20), up("variance_shift_ratio", 0.60, 1.5, 15), up("sign_imbalance", 0.80, 1, 10)])


def _points(table: str, columns: list[str]) -> str:
    run = "(PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"""{series(table, columns)},
a AS (SELECT *, greatest(hi - lo, sd, 1e-9) AS scale, sum(x - mean) OVER {run} AS cusum, x - sum(x) OVER {run} / (i + 1) - 0.005 * sd AS step,
        CASE WHEN i >= 20 AND i <= n - 20 THEN abs(avg(x) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
             - avg(x) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) END AS shift FROM s),
b AS (SELECT *, sum(step) OVER {run} AS ph, avg(cusum) OVER (PARTITION BY series) AS middle FROM a),
c AS (SELECT *, ph - least(0.0, min(ph) OVER {run}) AS ph_stat FROM b)"""


def page_hinkley(table: str, columns: list[str]) -> str:
    return _points(table, columns) + " SELECT i, round(cusum, 4) AS cusum, round(ph_stat, 4) AS ph_stat FROM c"


def changepoint(table: str, columns: list[str]) -> str:
    return f"""{_points(table, columns)},
f AS (SELECT series, any_value(n) AS n, any_value(sd) AS sd, max(shift / scale) AS best_window_mean_shift_ratio, (max(cusum) - min(cusum)) / (any_value(sd) * any_value(n)) AS cusum_ratio,
        max(ph_stat) / (any_value(sd) * sqrt(any_value(n))) AS page_hinkley_ratio, max(shift / scale) AS best, max(abs(cusum - middle)) AS far, max(ph_stat) AS ph FROM c GROUP BY series),
g AS (SELECT series, min(i) FILTER (shift / scale = best) AS best_window_index, min(i) FILTER (abs(cusum - middle) = far) AS cusum_index, min(i) FILTER (ph_stat = f.ph) AS page_hinkley_index FROM c JOIN f USING (series) GROUP BY series),
m AS (SELECT *, list_sort([best_window_index, cusum_index, page_hinkley_index])[2] AS likely_changepoint_index FROM f JOIN g USING (series))
""" + result(CHANGEPOINT, [up("best_window_mean_shift_ratio", 0.25, 0.80, 35), up("cusum_ratio", 0.18, 0.45, 25), up("page_hinkley_ratio", 2.5, 5, 25)])


def digit(table: str, columns: list[str]) -> str:
    """Columns here are no counts, rates or small discrete ranges: the continuous penalties, or the count's for l_quantity."""
    return f"""{series(table, columns)},
p AS (SELECT *, length(rtrim(split_part(printf('%.10f', x), '.', 2), '0')) AS places, CASE WHEN x - floor(x) <= 1e-8 THEN length(CAST(CAST(abs(round_even(x, 0)) AS BIGINT) AS VARCHAR)) END AS digits FROM s),
l AS (SELECT *, CAST(round_even(abs(x) * pow(10, places), 0) AS BIGINT) % 10 AS last FROM p),
k AS (SELECT series, max(c) FILTER (kind = 'p') AS places, max(c) FILTER (kind = 'l') AS last, count(*) FILTER (kind = 'd' AND v IS NOT NULL) AS digit_length_diversity FROM (
        SELECT series, 'p' AS kind, places AS v, count(*) AS c FROM l GROUP BY ALL UNION ALL SELECT series, 'l', last, count(*) FROM l GROUP BY ALL UNION ALL SELECT series, 'd', digits, count(*) FROM l GROUP BY ALL) GROUP BY series),
r AS (SELECT series, any_value(n) AS n, avg(CAST(x - floor(x) <= 1e-8 AS INT)) AS integer_rate, avg(CAST(x * 20 - floor(x * 20) <= 1e-8 AS INT)) AS rounded_0_05_rate, 1 - count(DISTINCT x) / count(*) AS duplicate_rate FROM l GROUP BY series),
m AS (SELECT r.*, k.places / n AS dominant_decimal_place_rate, k.last / n AS dominant_last_digit_rate, digit_length_diversity, CASE WHEN series = 'l_quantity' THEN 0 ELSE 4 END AS numeric_kind FROM r JOIN k USING (series))
""" + result(DIGIT, [f"CASE WHEN numeric_kind = 0 THEN {up('dominant_last_digit_rate', 0.75, 0.98, 8)} + {up('duplicate_rate', 0.92, 1, 6)} ELSE {up('integer_rate', 0.75, 1, 24)} + {up('dominant_decimal_place_rate', 0.9, 1, 20)} + {up('dominant_last_digit_rate', 0.35, 1, 18)} + {up('rounded_0_05_rate', 0.8, 1, 16)} + {up('duplicate_rate', 0.45, 1, 12)} END"])


def outlier(table: str, columns: list[str]) -> str:
    return f"""{series(table, columns)},
q AS (SELECT series, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY series),
m AS (SELECT series, any_value(n) AS n, avg(CAST(abs((x - mean) / sd) > 3 AS INT)) AS z_outlier_rate,
        avg(CAST(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) AS INT)) AS iqr_outlier_rate, any_value(sd) / (abs(any_value(mean)) + 1e-9) AS variation_cv FROM s JOIN q USING (series) GROUP BY series)
""" + result(OUTLIER, [down("greatest(z_outlier_rate, iqr_outlier_rate)", 0.02, 0, 28), up("greatest(z_outlier_rate, iqr_outlier_rate)", 0.25, 1, 24), down("greatest(z_outlier_rate, iqr_outlier_rate)", 0.02, 0, 10), down("variation_cv", 0.005, 0, 16)])


def profile(table: str, time: str | None, columns: dict[str, int]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS present, {f'count({c})' if k else '0'} AS numeric, count(DISTINCT {c}) AS n_distinct, {str(c == time).lower()} AS is_time, {str(bool(k)).lower()} AS is_numeric FROM {table}"
        for c, k in columns.items()
    )
    return f"WITH r AS ({rows}) SELECT *, round(1 - sum(present) OVER () / sum(n_rows) OVER (), 6) AS missing_rate FROM r"


SCREENING = "WITH r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS role, {str(r == 'numeric').lower()} AS entered_analysis, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, round(1 - count({c}) / count(*), 6) AS missing_rate FROM events"
    for c, r in (("event_id", "identifier"), ("ts", "time"), ("user_id", "identifier"), ("event_type", "text"), ("value", "numeric"), ("props", "text"))
) + ") SELECT * FROM r"
#: The screening as it is shown; what is said of a role stands in the operator's table of roles.
SCREENING_TABLE = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) AS n, count(DISTINCT {c}) AS unique_count, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS numbers, {'count(' + c + ')' if c == 'ts' else '0'} AS times FROM events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
) + f""") SELECT "column", role, role = 'numeric' AS entered_analysis, present AS non_null_count, printf('%.1f%%', 100.0 * (n - present) / n) AS missing_rate, unique_count,
  printf('%.1f%%', 100.0 * numbers / n) AS numeric_valid_rate, printf('%.1f%%', 100.0 * times / n) AS datetime_valid_rate, handling
FROM s JOIN (VALUES ('event_id', 'identifier'), ('ts', 'time'), ('user_id', 'identifier'), ('event_type', 'text'), ('value', 'numeric'), ('props', 'text')) r(c, role) ON "column" = c
JOIN (VALUES {", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in ROLES.items())}) h(k, handling) ON role = k"""  # fmt: skip
PREVIEW = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, round(value, 6) AS value FROM events ORDER BY events.ts, event_id LIMIT 30"
UNION = """SELECT nationkey, count(*) AS n, count(segment) AS n_segment, round(sum(acctbal), 4) AS acctbal FROM (
SELECT c_acctbal AS acctbal, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer UNION ALL SELECT s_acctbal, s_nationkey, NULL FROM supplier) GROUP BY nationkey"""
JACCARD = """SELECT * FROM (VALUES ('customer', 'supplier', round(3 / 6, 6), 'separate'), ('customer', 'nation', round(2 / 6, 6), 'separate'), ('supplier', 'nation', round(2 / 5, 6), 'separate')) t(a, b, jaccard, strategy)"""


def sampling(table: str, time: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT epoch_us({time}) AS t FROM {table} WHERE {time} IS NOT NULL),
d AS (SELECT (t - lag(t) OVER (ORDER BY t)) / 1e6 AS d FROM t), q AS (SELECT median(d) AS q FROM d WHERE d > 0),
m AS (SELECT '(table)' AS series, (SELECT count({time}) FROM {table}) AS n, 1 - (SELECT count(*) FROM t) / (SELECT count({time}) FROM {table}) AS duplicate_timestamp_ratio, stddev_pop(d) / avg(d) AS interval_cv,
  sum(CAST(d > 3 * q AS INT)) AS break_count, sum(greatest(floor(d / q) - 1, 0)) AS estimated_missing_slots, max(greatest(floor(d / q) - 1, 0)) AS longest_missing_run FROM d, q WHERE d > 0)
""" + result(SAMPLING, [up("duplicate_timestamp_ratio", 0.01, 0.10, 22), up("interval_cv", 0.35, 1.20, 22), "least(18.0, 4.0 * break_count)", up("longest_missing_run", 2, 12, 14)])


PHYSICAL = f"""WITH r AS (SELECT 'l_discount' AS "column", 'pest_count' AS rule, min(l_discount) AS lo, max(l_discount) AS hi, avg(CAST(l_discount < 0 OR l_discount > 1000000 AS INT)) AS h,
  avg(CAST(l_discount > 100000 AND l_discount <= 1000000 AS INT)) AS s FROM lineitem)
SELECT "column", rule, lo, hi, round(h, 6) AS hard_rate, round(s, 6) AS soft_rate, round({up("h", 0, 0.15, 28)}, 6) AS hard_penalty, round({up("s", 0.02, 0.30, 16)}, 6) AS soft_penalty, 0.0::DOUBLE AS unit_penalty FROM r"""
COVERAGE = "SELECT '(table)' AS \"column\", 3 AS n, 92.0::DOUBLE AS score, 0.0::DOUBLE AS matched_rule_count, 0.0::DOUBLE AS rule_coverage, 8.0::DOUBLE AS coverage_penalty"


def _pair_rows(table: str, columns: list[str]) -> str:
    ranks = ", ".join(f"CAST({c} AS DOUBLE) AS {c}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS pearson, corr(r_{a}, r_{b}) AS spearman FROM k" for a, b in pairs)
    return f"WITH k AS (SELECT {ranks} FROM {table}), p AS ({rows})"


def pairs(table: str, columns: list[str]) -> str:
    return _pair_rows(table, columns) + ' SELECT "left", "right", round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM p'


def corr_score(table: str, columns: list[str]) -> str:
    return f"""{_pair_rows(table, columns)},
m AS (SELECT '(table)' AS series, {len(columns)} AS n, count(*) AS pair_count, avg(abs(pearson)) AS average_abs_pearson, max(greatest(abs(pearson), abs(spearman))) AS max_abs_correlation,
  sum(CAST(greatest(abs(pearson), abs(spearman)) > 0.99 AS INT)) AS high_pair_count FROM p)
""" + result(CORRELATION, [up("max_abs_correlation", 0.999, 1, 35), up("least(max_abs_correlation, 0.999)", 0.99, 0.999, 14), up("average_abs_pearson", 0.96, 1, 18)])


def robust(table: str, columns: list[str]) -> str:
    ends = ", ".join(f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}" for c in columns)
    outs = ", ".join(f"round({f}(({c} - m_{c}) / w_{c}), 6) AS {c}_{k}" for c in columns for k, f in (("mean", "avg"), ("sd", "stddev_pop"), ("lo", "min"), ("hi", "max")))
    return f"WITH e AS (SELECT {ends} FROM {table}) SELECT {outs} FROM {table}, e"


_RAW = ", ".join(f"('{s}', '{n}', {config.RELEVANCE[n][k]}::DOUBLE)" for k, s in enumerate(config.SCENARIOS) for n in config.CORE)
WEIGHTS = f"SELECT scenario, indicator, round(w / sum(w) OVER (PARTITION BY scenario), 6) AS weight FROM (VALUES {_RAW}) t(scenario, indicator, w)"
GUARD = """SELECT core, raw_total_score, t AS total_score, CASE WHEN t >= 70 THEN 'low' WHEN t >= 50 THEN 'medium' ELSE 'high' END AS risk_level FROM (
SELECT core, raw_total_score, CASE WHEN core < 35 THEN least(raw_total_score, 59.99) WHEN core < 50 THEN least(raw_total_score, 69.99) ELSE raw_total_score END AS t
FROM (VALUES (34.9::DOUBLE, 80.0::DOUBLE), (34.9, 59.0), (35.0, 80.0), (49.9, 80.0), (49.9, 65.0), (50.0, 80.0), (NULL, 80.0)) t(core, raw_total_score))"""
ROLLUP = """WITH s AS (SELECT event_type, count(*) AS n, 100 * avg(CAST(value > 20 AS INT)) AS score FROM events GROUP BY event_type)
SELECT 'share_over_20' AS indicator, round(sum(score * n) / sum(n), 2) AS score FROM s"""


def matched(columns: dict[str, tuple[str, str, tuple, tuple]]) -> str:
    """columns: source column by name, rule, soft and hard bounds."""
    parts = []
    for name, (source, rule, soft, hard) in columns.items():
        outside = lambda b, source=source: f"({source} < {b[0]} OR {source} > {b[1]})"
        parts.append(f"""SELECT '{name}' AS "column", '{rule}' AS rule, {soft[0]}::DOUBLE AS soft_min, {soft[1]}::DOUBLE AS soft_max, {hard[0]}::DOUBLE AS hard_min, {hard[1]}::DOUBLE AS hard_max,
  round(min({source})::DOUBLE, 4) AS min, round(max({source})::DOUBLE, 4) AS max, avg({outside(hard)}::INT) AS h, avg(({outside(soft)} AND NOT {outside(hard)})::INT) AS s FROM lineitem""")
    return f"""SELECT "column", rule, soft_min, soft_max, hard_min, hard_max, min, max, round(h, 4) AS hard_out_of_range_rate, round(s, 4) AS soft_out_of_range_rate,
  ((rule IN ('humidity', 'soil_moisture') AND min >= 0 AND max <= 1)::INT + (h > 0)::INT + (s > 0.02)::INT) AS notes FROM ({' UNION ALL '.join(parts)})"""


MATCHED = matched({
    "rainfall": ("l_quantity", "rainfall", (0, 300), (0, 1000)), "leaf_temperature": ("l_extendedprice", "temperature", (-20, 60), (-50, 80)),
    "soil_moisture": ("l_discount", "soil_moisture", (0, 100), (0, 100)), "co2": ("l_tax", "co2", (250, 5000), (0, 10000)),
})


def total(table: str, column: str, time: str) -> str:
    w = config.weights(["smoothness", "digit", "timeseries", "drift"])
    parts = {"smoothness": smooth, "digit": digit, "timeseries": timeseries, "drift": drift}
    scores = ", ".join(f"(SELECT round(score, 2) FROM ({f(table, [column])})) AS {k}" for k, f in parts.items())
    raw = " + ".join(f"{k} * {w[k]}" for k in parts)
    return f"""WITH p AS (SELECT {scores}), r AS (SELECT round({raw}, 2) AS raw_total_score, least(smoothness, digit) AS core FROM p),
g AS (SELECT *, CASE WHEN core < 35 THEN least(raw_total_score, 59.99) WHEN core < 50 THEN least(raw_total_score, 69.99) ELSE raw_total_score END AS total_score FROM r)
SELECT raw_total_score, core, total_score, CASE WHEN total_score >= 70 THEN 'low' WHEN total_score >= 50 THEN 'medium' ELSE 'high' END AS risk_level FROM g"""


WINDOWED = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY day"


#: Types of the events table; `wide` has a column for each type's values.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_WIDE = "SELECT ts, event_id, " + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS t_{t}" for t in EVENT_TYPES) + " FROM events"
DRIFT_ROLLUP = f"""WITH scores AS ({drift("wide", [f"t_{t}" for t in EVENT_TYPES]).replace("WITH s AS", f"WITH wide AS ({_WIDE}), s AS", 1)}),
rows AS (SELECT 't_' || event_type AS sheet, count(*) AS n FROM events GROUP BY 1)
SELECT 'drift' AS indicator, round(sum(score * rows.n) / sum(rows.n), 2) AS score FROM scores JOIN rows ON "column" = sheet"""
