"""SQL, in DuckDB's dialect, for the registered queries: written from the definitions, as common table expressions that build on each other."""

from __future__ import annotations

SERIES = "s AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id, value) - 1 AS idx, ts AS timestamp, value FROM events)"
GAPPY = SERIES.replace(", value FROM", ", CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM")
NUMBERED = SERIES.replace(", value FROM", ", CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM")
EMPTIED = SERIES.replace(", value FROM", ", CASE WHEN event_type <> 'click' THEN value END AS value FROM")
DROPPED = [GAPPY.replace("s AS", "s0 AS", 1), "s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS idx, timestamp, value, idx AS idx0 FROM s0 WHERE value IS NOT NULL)"]
USERS = SERIES.replace("event_type", "user_id").replace("user_id AS", "user_id::varchar AS")
W = "PARTITION BY series_id ORDER BY idx"
G = "PARTITION BY series_id"


def sql(ctes: list[str] | str, select: str) -> str:
    ctes = [ctes] if isinstance(ctes, str) else ctes
    return f"WITH {', '.join(ctes)} SELECT {select}"


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) AS {name or expression}"


def q(a: str, b: str) -> str:
    """a / b, and 0 where that is null or not finite."""
    return f"CASE WHEN ({a}) / nullif({b}, 0) IS NULL OR NOT isfinite(({a}) / nullif({b}, 0)) THEN 0.0 ELSE ({a}) / nullif({b}, 0) END"


def rolling(width: int, back: int, ahead: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f"CASE WHEN count(value) {f} >= {width // 2} THEN avg(value) {f} END AS m, CASE WHEN count(value) {f} >= {width // 2} THEN stddev_samp(value) {f} END AS sd"


def threshold(signal: str, method: str, value: float, name: str = "t") -> str:
    if method == "fixed":
        return f"{value}::double AS {name}"
    if method == "percentile":
        return f"quantile_cont({signal}, {value / 100!r}) OVER ({G}) AS {name}"
    return f"avg({signal}) OVER ({G}) + {value} * stddev_pop({signal}) OVER ({G}) AS {name}"


def capped(signal: str, t: str = "t") -> str:
    return f"CASE WHEN {t} > 0 THEN least({signal} / {t}, 1.0) ELSE 0.0 END"


def simple_result(name: str, source: str, signal: str, kind: str = "Spike") -> str:
    signal = f"coalesce({signal}, 0.0)"
    hit = f"coalesce(t > 0 AND {signal} >= t, false)"
    return f"{name} AS (SELECT series_id, idx, timestamp, value, {capped(signal)} AS score, {hit}::int AS label, CASE WHEN {hit} THEN '{kind}' ELSE '' END AS detection_type FROM {source})"


def zscore(name: str, method: str, value: float) -> list[str]:
    return [
        f"{name}_a AS (SELECT *, {rolling(20, 19, 0)} FROM s)",
        f"{name}_b AS (SELECT *, abs({q('value - m', 'sd')}) AS z FROM {name}_a)",
        f"{name}_c AS (SELECT *, {threshold('z', method, value)} FROM {name}_b)",
        simple_result(name, f"{name}_c", "z"),
    ]


def prederr(name: str, method: str, value: float, smoothing: int = 1) -> list[str]:
    half = (smoothing - 1) // 2
    smooth = f"avg(e) OVER ({W} ROWS BETWEEN {smoothing - 1 - half} PRECEDING AND {half} FOLLOWING)"
    t = threshold("e", "adaptive", value) if method == "fixed" else threshold("es", method, value)
    return [
        f"{name}_a AS (SELECT *, CASE WHEN idx < 10 THEN avg(CASE WHEN idx < 10 THEN value END) OVER ({G}) ELSE avg(value) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS p FROM s)",
        f"{name}_b AS (SELECT *, abs(value - p) AS e FROM {name}_a)",
        f"{name}_c AS (SELECT *, {smooth} AS es FROM {name}_b)",
        f"{name}_d AS (SELECT *, {t} FROM {name}_c)",
        simple_result(name, f"{name}_d", "es"),
    ]


SLOPE = f"CASE WHEN lag(value, 2) OVER ({W}) IS NOT NULL AND lead(value, 2) OVER ({W}) IS NOT NULL THEN (lead(value, 1) OVER ({W}) - lag(value, 1) OVER ({W}) + 2 * (lead(value, 2) OVER ({W}) - lag(value, 2) OVER ({W}))) / 10.0 ELSE 0.0 END"


def gradient(column: str) -> str:
    after, before = f"lead({column}) OVER ({W})", f"lag({column}) OVER ({W})"
    return f"coalesce(({after} - {before}) / 2, {after} - {column}, {column} - {before}, 0.0)"


def hybrid(name: str, method: str, value: float) -> list[str]:
    v = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"
    f = f"OVER ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"
    near = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    fixed = {"zt": 3.5, "gt": 1.2, "vt": 3.5}
    thresholds = ", ".join(threshold(c, method, fixed[t] if method == "fixed" else value, t) for c, t in (("z", "zt"), ("g", "gt"), ("v", "vt")))
    edges = ", ".join(f"({c} AND NOT coalesce(lag({c}) OVER ({W}), false)) AS {c}_edge" for c in ("strong", "flat"))
    kind = "CASE WHEN zn >= gn AND zn >= vn THEN 'Spike' WHEN gn >= vn THEN CASE WHEN near > 0 THEN 'Spike' WHEN steady < 0.5 THEN 'Volatility' ELSE 'Trend' END ELSE 'Volatility' END"
    return [
        f"{name}_a AS (SELECT *, {rolling(20, 10, 9)}, {SLOPE} AS trend, CASE WHEN count(value) {v} >= 5 THEN stddev_samp(value) {v} END AS vol, CASE WHEN count(value) {f} >= 40 THEN max(value) {f} - min(value) {f} END AS rr, max(value) OVER ({G}) - min(value) OVER ({G}) AS span0 FROM s)",
        f"{name}_b AS (SELECT *, abs({q('value - m', 'sd')}) AS z, abs({gradient('trend')}) AS g, avg(vol) OVER ({G}) AS vm, stddev_pop(vol) OVER ({G}) AS vs, CASE WHEN span0 = 0 THEN 1.0 ELSE span0 END AS span FROM {name}_a)",
        f"{name}_c AS (SELECT *, greatest({q('vol - vm', 'vs')}, 0.0) AS v, (idx >= 40 AND coalesce(rr, span) < greatest(span * 0.01, 1e-6)) AS flat FROM {name}_b)",
        f"{name}_d AS (SELECT *, {thresholds} FROM {name}_c)",
        f"{name}_e AS (SELECT *, {capped('z', 'zt')} AS zn, {capped('g', 'gt')} AS gn, {capped('v', 'vt')} AS vn, (vt > 0 AND v >= 2.5 * vt) AS strong FROM {name}_d)",
        f"{name}_f AS (SELECT *, 0.5 * zn + 0.3 * gn + 0.2 * vn AS total, {edges}, sum((zn >= gn AND zn >= vn)::int) {near} AS near, abs(sum(sign(trend)) {near}) / 11.0 AS steady FROM {name}_e)",
        f"{name}_g AS (SELECT *, (total / 1.0 >= 0.80 OR strong_edge OR flat_edge) AS hit, CASE WHEN strong_edge OR flat_edge THEN greatest(total, 0.85) ELSE total END AS score FROM {name}_f)",
        f"{name} AS (SELECT series_id, idx, timestamp, value, score, hit::int AS label, CASE WHEN NOT hit THEN '' WHEN flat_edge THEN 'Flatline' WHEN strong_edge THEN 'Volatility' ELSE {kind} END AS detection_type FROM {name}_g)",
    ]


def mean_shift(name: str, method: str, value: float) -> list[str]:
    before, after = f"OVER ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)", f"OVER ({W} ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)"
    return [
        f"{name}_a AS (SELECT *, count(*) OVER ({G}) AS n, stddev_pop(value) OVER ({G}) AS sd, avg(value) {before} AS mb, stddev_pop(value) {before} AS sb, avg(value) {after} AS ma FROM s)",
        f"{name}_b AS (SELECT *, CASE WHEN idx >= 50 AND idx < n - 50 THEN abs(ma - mb) / greatest(sb, sd * 0.01, 1e-4) ELSE 0.0 END AS raw FROM {name}_a)",
        f"{name}_c AS (SELECT *, {threshold('raw', method, value)} FROM {name}_b)",
        f"{name}_d AS (SELECT *, {capped('raw')} AS score, (t > 0 AND raw >= t) AS above FROM {name}_c)",
        f"{name}_e AS (SELECT *, idx - sum(above::bigint) OVER ({W}) AS run FROM {name}_d)",
        f"{name}_f AS (SELECT *, above AND row_number() OVER (PARTITION BY series_id, above, run ORDER BY raw DESC, idx) = 1 AS hit FROM {name}_e)",
        f"{name} AS (SELECT series_id, idx, timestamp, value, score, hit::int AS label, CASE WHEN hit THEN 'Level Shift' ELSE '' END AS detection_type FROM {name}_f)",
    ]


FOUND = f"series_id, idx, {r('score')}, label, detection_type FROM d"
DETECTORS = {"rolling_zscore": zscore, "prediction_error": prederr, "hybrid": hybrid, "mean_shift": mean_shift}


def long_form(k: float) -> list[str]:
    parts = [c for n, make in DETECTORS.items() for c in make(n, "adaptive", k)]
    return [SERIES, *parts, "l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS algorithm, * FROM {n}" for n in DETECTORS) + ")"]


SPANS = [
    f"p AS (SELECT *, quantile_cont(value, 0.99) OVER ({G}) AS p99 FROM s)",
    "spans AS (SELECT series_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM p WHERE value > p99 GROUP BY series_id, time_bucket(INTERVAL '12 hours', timestamp))",
    "spans_n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_ts) - 1 AS interval_id FROM spans)",
    "ix AS (SELECT x.series_id, x.interval_id, min(CASE WHEN s.timestamp >= x.start_ts THEN s.idx END) AS start_idx, max(CASE WHEN s.timestamp <= x.end_ts THEN s.idx END) + 1 AS end_idx FROM spans_n x JOIN s USING (series_id) GROUP BY ALL)",
]
MASK = "mask AS (SELECT s.series_id, s.idx, (EXISTS (SELECT 1 FROM spans x WHERE x.series_id = s.series_id AND s.timestamp BETWEEN x.start_ts AND x.end_ts))::int AS truth FROM s)"
JUDGED = [SERIES, *SPANS, MASK, *zscore("d", "adaptive", 3.0), "j AS (SELECT d.*, truth FROM d JOIN mask USING (series_id, idx))"]
COUNTS = "c AS (SELECT series_id, count(*) FILTER (truth = 1 AND label = 1) AS tp, count(*) FILTER (truth = 0 AND label = 1) AS fp, count(*) FILTER (truth = 1 AND label = 0) AS fn, count(*) FILTER (truth = 0 AND label = 0) AS tn FROM j GROUP BY series_id)"


def metrics(source: str, name: str = "mx") -> list[str]:
    return [
        f"{name}_a AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0)::double AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0)::double AS recall, coalesce(fp / nullif(fp + tn, 0), 0.0)::double AS fpr FROM {source})",
        f"{name} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM {name}_a)",
    ]


METRICS = ", ".join(["series_id, tp, fp, fn, tn", *map(r, ("precision", "recall", "f1", "fpr"))])


def fuzzy(points: str, name: str, tolerance: int = 5) -> list[str]:
    return [
        f"{name}_n AS (SELECT series_id, count(*) AS n FROM s GROUP BY series_id)",
        f"{name}_z AS (SELECT ix.*, greatest(0, start_idx - {tolerance}) AS a, least(n, end_idx + {tolerance}) AS b FROM ix JOIN {name}_n USING (series_id))",
        f"{name}_h AS (SELECT series_id, count(*) AS spans, sum(end_idx - start_idx)::bigint AS covered, count(*) FILTER (EXISTS (SELECT 1 FROM {points} p WHERE p.label = 1 AND p.series_id = z.series_id AND p.idx BETWEEN z.a AND z.b)) AS tp FROM {name}_z z GROUP BY series_id)",
        f"{name}_f AS (SELECT series_id, count(*) FILTER (label = 1 AND NOT EXISTS (SELECT 1 FROM {name}_z z WHERE z.series_id = p.series_id AND p.idx BETWEEN z.a AND z.b)) AS fp FROM {points} p GROUP BY series_id)",
        f"{name}_c AS (SELECT series_id, coalesce(tp, 0)::bigint AS tp, fp, (coalesce(spans, 0) - coalesce(tp, 0))::bigint AS fn, (n - coalesce(covered, 0) - fp)::bigint AS tn FROM {name}_n LEFT JOIN {name}_h USING (series_id) LEFT JOIN {name}_f USING (series_id))",
        *metrics(f"{name}_c", name),
    ]


SIMPLE = ["sc AS (SELECT series_id, fp, fn, greatest(0.0, 100 - (0.11 * fp + fn))::double AS score FROM (SELECT series_id, count(*) FILTER (used AND truth = 0 AND label = 1) AS fp, count(*) FILTER (used AND truth = 1 AND label = 0) AS fn FROM (SELECT *, idx >= greatest(floor(count(*) OVER (PARTITION BY series_id) * 0.15), 750) AS used FROM j) GROUP BY series_id))"]

_grid: list[str] = [SERIES, *SPANS]
_parts = []
for _label, _k in (("Low", 4.0), ("Medium", 3.0)):
    for _n, _make in DETECTORS.items():
        _name = f"{_n}_{_label}"
        _grid += [*_make(_name, "adaptive", _k), *fuzzy(_name, f"fz_{_name}")]
        _parts.append(f"SELECT series_id, '{_n}' AS algorithm, '{_label}' AS threshold, precision, recall, f1, tp, fp, fn FROM fz_{_name}")
GRID = [*_grid, "grid AS (" + " UNION ALL ".join(_parts) + ")"]
MEANS = [*GRID, "means AS (SELECT algorithm, threshold, round(avg(precision), 4) AS avg_precision, round(avg(recall), 4) AS avg_recall, round(avg(f1), 4) AS avg_f1 FROM grid GROUP BY ALL)"]

FILLED = [
    GAPPY,
    f"f AS (SELECT *, last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, max(CASE WHEN value IS NOT NULL THEN idx END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi, min(CASE WHEN value IS NOT NULL THEN idx END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM s)",
]
INTERPOLATED = "coalesce(value, pv + (nv - pv) * ((idx - pi)::double / nullif(ni - pi, 0)), nv, pv)"
STATS = f"series_id, count(value) AS count, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, {r('median(value)', 'median')}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.75)', 'q75')}, {r('skewness(value)', 'skewness')}, {r('kurtosis(value)', 'kurtosis')} FROM s GROUP BY series_id"
GLOBAL = [SERIES, f"g AS (SELECT *, avg(value) OVER ({G}) AS mean, stddev_samp(value) OVER ({G}) AS std FROM s)", "z AS (SELECT *, CASE WHEN std > 0 THEN abs(value - mean) / std ELSE 0.0 END AS zscore FROM g)"]
QUARTILES = [SERIES, f"g AS (SELECT *, quantile_cont(value, 0.25) OVER ({G}) AS q1, quantile_cont(value, 0.75) OVER ({G}) AS q3 FROM s)", "x AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM g)"]


def tumbling(interval: str) -> list[str]:
    w = f"OVER (PARTITION BY series_id, time_bucket(INTERVAL '{interval}', timestamp))"
    return [SERIES, f"b AS (SELECT *, avg(value) {w} AS mean, stddev_samp(value) {w} AS std, count(value) {w} AS n, quantile_cont(value, 0.25) {w} AS q1, quantile_cont(value, 0.75) {w} AS q3 FROM s)"]


DOWN = [
    SERIES,
    f"n AS (SELECT *, count(*) OVER ({G}) AS total FROM s)",
    "bk AS (SELECT n.*, (SELECT max(k) FROM range(150) t(k) WHERE floor(k * (total / 150.0::double)) <= idx) AS bucket FROM n)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, bucket ORDER BY value, idx) AS lo, row_number() OVER (PARTITION BY series_id, bucket ORDER BY value DESC, idx) AS hi FROM bk)",
    "down AS (SELECT series_id, idx, timestamp, value FROM rk WHERE total <= 300 OR lo = 1 OR hi = 1)",
]
FOREST = [
    SERIES,
    f"a AS (SELECT *, {rolling(20, 10, 9)}, coalesce(abs(value - lag(value) OVER ({W})), 0.0) AS f_diff, avg(value) OVER ({G}) AS am, stddev_samp(value) OVER ({G}) AS asd, quantile_cont(value, 0.99) OVER ({G}) AS p99 FROM s)",
    "b AS (SELECT *, coalesce(m, am) AS f_mean, coalesce(sd, asd) AS f_std, CASE WHEN value > p99 THEN value END AS high FROM a)",
    f"c AS (SELECT *, CASE WHEN count(high) OVER ({G}) >= 2 THEN quantile_cont(high, 0.5) OVER ({G}) ELSE p99 END AS spike, avg(f_std) OVER ({G}) AS sm, stddev_pop(f_std) OVER ({G}) AS ss FROM b)",
]
FRAME = "OVER ({w} ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
_ten, _forty = FRAME.format(w=W, a=9, b=0), FRAME.format(w=W, a=39, b=0)
_full = lambda f: f"CASE WHEN count(value) {_forty} >= 40 THEN {f} END"



def sigmoid(x: str) -> str:
    return f"CASE WHEN {x} > 3.0 THEN -1.0 ELSE 2.0 / (1.0 + exp(5.0 * ({x}))) - 1.0 END"


SWEEP = [
    *GLOBAL, *SPANS,
    f"sp AS (SELECT series_id, idx, least(zscore / 2.5, 1.0) AS score, count(*) OVER ({G}) AS n FROM z)",
    "sa AS (SELECT sp.*, start_idx, end_idx FROM (SELECT * FROM sp WHERE idx >= floor(least(n, 5000) * 0.15)) sp ASOF LEFT JOIN ix ON sp.series_id = ix.series_id AND sp.idx >= ix.start_idx)",
    f"sb AS (SELECT *, coalesce(idx < end_idx, false) AS inside, CASE WHEN end_idx IS NULL THEN -0.11 WHEN idx < end_idx THEN ({sigmoid('-(end_idx - idx)::double / (end_idx - start_idx)')}) / (2.0 / (1.0 + exp(-5.0)) - 1.0) ELSE 0.11 * ({sigmoid('(idx - end_idx + 1)::double / greatest(end_idx - start_idx - 1, 1)')}) END AS points FROM sa)",
    "st AS (SELECT DISTINCT score AS t FROM sb)",
    "sw AS (SELECT t, sum(g) AS g, count(*) AS tp FROM (SELECT t, series_id, start_idx, arg_min(points, idx) AS g FROM st JOIN sb ON inside AND score >= t GROUP BY ALL) GROUP BY t)",
    "so AS (SELECT t, sum(points) AS g, count(*) AS fp FROM st JOIN sb ON NOT inside AND score >= t GROUP BY t)",
    "sc AS (SELECT t AS threshold, coalesce(sw.g, 0) + coalesce(so.g, 0) - ((SELECT count(*) FROM ix) - coalesce(tp, 0)) AS raw_score, coalesce(tp, 0)::bigint AS tp, coalesce(fp, 0)::bigint AS fp, ((SELECT count(*) FROM ix) - coalesce(tp, 0))::bigint AS fn FROM st LEFT JOIN sw USING (t) LEFT JOIN so USING (t))",
]

SQL: dict[str, str] = {
    "fill_interpolate": sql(FILLED, f"series_id, idx, {r(INTERPOLATED, 'value')} FROM f"),
    "fill_ffill": sql(FILLED, f"series_id, idx, {r('coalesce(pv, nv)', 'value')} FROM f"),
    "fill_mean": sql(GAPPY, f"series_id, idx, {r(f'coalesce(value, avg(value) OVER ({G}))', 'value')} FROM s"),
    "fill_drop": sql(GAPPY, f"series_id, idx, {r('value')} FROM s WHERE value IS NOT NULL"),
    "scale_standard": sql(SERIES, f"series_id, idx, {r(q(f'value - avg(value) OVER ({G})', f'stddev_pop(value) OVER ({G})'), 'value_normalized')} FROM s"),
    "scale_minmax": sql(SERIES, f"series_id, idx, {r(q(f'value - min(value) OVER ({G})', f'max(value) OVER ({G}) - min(value) OVER ({G})'), 'value_normalized')} FROM s"),
    "scale_robust": sql([SERIES, f"p AS (SELECT *, quantile_cont(value, 0.01) OVER ({G}) AS lo, quantile_cont(value, 0.99) OVER ({G}) AS hi FROM s)", "x AS (SELECT series_id, idx, least(greatest(value, lo), hi) AS value FROM p)"], f"series_id, idx, {r('value')}, {r(q(f'value - avg(value) OVER ({G})', f'stddev_pop(value) OVER ({G})'), 'value_normalized')} FROM x"),
    "denormalize": sql(SERIES, f"series_id, idx, {r(q(f'value - avg(value) OVER ({G})', f'stddev_pop(value) OVER ({G})'), 'value_normalized')}, {r('value', 'value_denormalized')} FROM s"),
    "preprocess": sql([*FILLED, f"x AS (SELECT series_id, idx, {INTERPOLATED} AS value FROM f)"], f"series_id, idx, {r('value')}, {r(q(f'value - min(value) OVER ({G})', f'max(value) OVER ({G}) - min(value) OVER ({G})'), 'value_normalized')} FROM x"),
    "series_stats": sql(SERIES, STATS),
    "series_stats_nan": sql(NUMBERED, STATS),
    "fill_nan": sql([NUMBERED, *FILLED[1:]], f"series_id, idx, {r(INTERPOLATED, 'value')} FROM f"),
    "prederr_empty_series": sql([EMPTIED, *prederr("d", "adaptive", 3.0, 3)], FOUND),
    "global_zscore_gaps": sql([GAPPY, *GLOBAL[1:2], "z AS (SELECT *, CASE WHEN std > 0 AND value IS NOT NULL THEN abs(value - mean) / std ELSE 0.0 END AS zscore FROM g)"], f"series_id, idx, {r('zscore')}, {r('least(zscore / 2.5, 1.0)', 'score')}, (zscore > 2.5)::int AS label FROM z"),
    "fuzzy_repeated": sql([SERIES, *SPANS[:-1], SPANS[-1].replace("ix AS", "ix0 AS", 1), "ix AS (SELECT * FROM ix0 UNION ALL SELECT * FROM ix0)", *JUDGED[1 + len(SPANS):], *fuzzy("j", "fz")], f"{METRICS}, {r('greatest(0.0, 100 - (0.11::double * fp + fn))', 'score')} FROM fz"),
    "labelled_stats": sql(USERS, f"series_id, count(*) AS rows, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')}, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_ts FROM s GROUP BY series_id"),
    "series_by_days": sql(SERIES, f"series_id, idx, {r('value')} FROM s"),
    "tile": sql([SERIES, f"n AS (SELECT *, count(*) OVER ({G}) AS total FROM s)"], f"series_id, (idx + k * total)::bigint AS idx, {r('value')} FROM n, range(3) t(k)"),
    "rolling_trailing": sql([SERIES, f"a AS (SELECT *, {rolling(20, 19, 0)} FROM s)"], f"series_id, idx, {r('m', 'rolling_mean')}, {r('sd', 'rolling_std')} FROM a"),
    "rolling_centered": sql([SERIES, f"a AS (SELECT *, {rolling(20, 10, 9)} FROM s)"], f"series_id, idx, {r('m', 'rolling_mean')}, {r('sd', 'rolling_std')} FROM a"),
    "rolling_users": sql([USERS, f"a AS (SELECT *, {rolling(20, 19, 0)} FROM s)"], f"series_id, idx, {r('m', 'rolling_mean')}, {r('sd', 'rolling_std')} FROM a"),
    "rolling_range": sql(SERIES, f"series_id, idx, {r(_full(f'max(value) {_forty}'), 'rolling_max')}, {r(_full(f'min(value) {_forty}'), 'rolling_min')}, {r(_full(f'max(value) {_forty} - min(value) {_forty}'), 'rolling_range')} FROM s"),
    "sliding_features": sql(SERIES, f"series_id, idx, idx + 1 AS row_num, {r(f'avg(value) {_ten}', 'window_mean_10')}, {r(f'stddev_samp(value) {_ten}', 'window_std_10')} FROM s"),
    "rolling_matrix": sql([SERIES, f"a AS (SELECT *, {{f}} FROM s)".format(f=", ".join(f"{x}(value) {FRAME.format(w=W, a=0, b=15)} AS {y}" for x, y in (("count", "n"), ("sum", "total"), ("last", "l"))))], f"series_id, idx AS start, idx + 8 AS centre, {r('total')}, {r('value', 'first')}, {r('l', 'last')} FROM a WHERE idx % 4 = 0 AND n = 16"),
    "forecast_ma": sql([SERIES, *prederr("d", "adaptive", 3.0)], f"series_id, idx, {r('p', 'prediction')} FROM d_a"),
    "error_smoothing": sql([SERIES, f"a AS (SELECT *, coalesce(abs(value - lag(value) OVER ({W})), 0.0) AS x FROM s)"], f"series_id, idx, {r('x', 'abs_diff')}, {r(f'avg(x) {FRAME.format(w=W, a=2, b=2)}', 'smooth')} FROM a"),
    "trend_slope": sql(SERIES, f"series_id, idx, {r(SLOPE, 'trend')} FROM s"),
    "trend_gradient": sql([SERIES, f"a AS (SELECT *, {SLOPE} AS trend FROM s)"], f"series_id, idx, {r('trend')}, {r(gradient('trend'), 'gradient')} FROM a"),
    "box_count": sql(SERIES, f"series_id, idx, (sum((value > 100)::int) {FRAME.format(w=W, a=5, b=5)})::bigint AS box_count FROM s"),
    "downsample_minmax": sql(DOWN, f"series_id, idx, {r('value')} FROM down"),
    "histogram": sql([SERIES, f"m AS (SELECT *, min(value) OVER ({G}) AS lo, max(value) OVER ({G}) AS hi FROM s)"], "series_id, (CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30) + 1, 30) ELSE 1 END)::int AS bin, count(*) AS n FROM m GROUP BY ALL"),
    "sampled_with_anomalies": sql([*DOWN, *GLOBAL[1:], "u AS (SELECT 0 AS part, * FROM down UNION ALL SELECT 1, series_id, idx, timestamp, value FROM z WHERE zscore > 2.5)", "k AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp ORDER BY part, idx) AS rank FROM u)"], f"series_id, idx, {r('value')} FROM k WHERE rank = 1"),
    "global_zscore": sql(GLOBAL, f"series_id, idx, {r('zscore')}, {r('least(zscore / 2.5, 1.0)', 'score')}, (zscore > 2.5)::int AS label FROM z"),
    "global_zscore_filter": sql(GLOBAL, f"series_id, idx, {r('value')}, {r('mean')}, {r('std')}, {r('zscore')} FROM z WHERE zscore > 2.0"),
    "simple_sigma_filter": sql(GLOBAL, f"series_id, idx, {r('value')}, {r('zscore')} FROM z WHERE zscore > 1.0"),
    "iqr": sql(QUARTILES, f"series_id, idx, {', '.join(map(r, ('value', 'q1', 'q3', 'lower', 'upper')))} FROM x WHERE value < lower OR value > upper"),
    "tumbling_zscore": sql(tumbling("6 hours"), f"series_id, idx, {r('value')}, {r('mean')}, {r('std')}, n, {r('abs(value - mean) / std', 'zscore')} FROM b WHERE std > 0 AND abs(value - mean) / std > 2.0"),
    "tumbling_iqr": sql(tumbling("6 hours"), f"series_id, idx, {r('value')}, {r('q1')}, {r('q3')} FROM b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"),
    "spark_rolling": sql([SERIES, f"a AS (SELECT *, avg(value) {FRAME.format(w=W, a=19, b=0)} AS m, coalesce(stddev_samp(value) {FRAME.format(w=W, a=19, b=0)}, 0.0) AS sd FROM s)", f"b AS (SELECT *, abs({q('value - m', 'sd')}) AS z FROM a)", f"c AS (SELECT *, {threshold('z', 'percentile', 99.5)} FROM b)", simple_result("d", "c", "z")], FOUND),
    "compare_methods": sql([*GLOBAL, *QUARTILES[1:2], *tumbling("5 minutes")[1:]], "'zscore' AS method, count(*) AS anomalies FROM z WHERE zscore > 2.0").replace("g AS (SELECT *, quantile_cont", "gq AS (SELECT *, quantile_cont") + " UNION ALL SELECT 'iqr', count(*) FROM gq WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) UNION ALL SELECT 'window', count(*) FROM b WHERE std > 0 AND abs(value - mean) / std > 2.0",
    "hybrid_types": sql([SERIES, *hybrid("d", "percentile", 90.1)], "series_id, detection_type, count(*) AS n FROM d WHERE label = 1 GROUP BY ALL"),
    "zscore_long_series": sql([SERIES, *zscore("d", "adaptive", 3.0)], FOUND),
    "detect_all": sql(long_form(3.0), f"algorithm, {FOUND.replace('FROM d', 'FROM l')}"),
    "detect_wide": sql(long_form(3.0), "series_id, idx, " + ", ".join(f"max(label) FILTER (algorithm = '{n}') AS {n}_anomaly, round(max(score) FILTER (algorithm = '{n}'), 6) AS {n}_score" for n in DETECTORS) + " FROM l GROUP BY series_id, idx"),
    "ensemble": sql(long_form(3.0), f"series_id, idx, {r('avg(score)', 'score')}, (avg(label) >= 0.5)::int AS label FROM l GROUP BY series_id, idx"),
    "run_summary": sql(long_form(3.0), f"algorithm, count(*) AS points, sum(label)::bigint AS anomalies, {r('sum(label) * 100.0::double / count(*)', 'percent')}, {r('min(score)', 'min_score')}, {r('max(score)', 'max_score')}, {r('avg(score)', 'mean_score')} FROM l GROUP BY algorithm"),
    "top_anomalies": sql([SERIES, *zscore("d", "adaptive", 3.0)], f"{FOUND} WHERE label = 1 ORDER BY series_id, idx LIMIT 100"),
    "dominant_type": sql([SERIES, *hybrid("d", "percentile", 90.1), "c AS (SELECT series_id, detection_type, count(*) AS n, min(idx) AS i FROM d WHERE label = 1 AND detection_type <> '' GROUP BY ALL)", "k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, i) AS rank FROM c)"], "series_id, detection_type AS dominant_type, n FROM k WHERE rank = 1"),
    "if_features": sql(FOREST, f"series_id, idx, {', '.join(map(r, ('value', 'f_mean', 'f_std', 'f_diff')))}, {r('value / (spike + 1e-8)', 'f_ratio')}, {r('greatest(0.0, (sm - f_std) / (ss + 1e-8))', 'f_flat')} FROM c"),
    "interval_to_index": sql([SERIES, *SPANS], "series_id, interval_id, start_idx, end_idx FROM ix"),
    "point_mask": sql([SERIES, *SPANS, MASK], "series_id, idx, truth FROM mask"),
    "confusion": sql([*JUDGED, COUNTS], "series_id, tp, fp, fn, tn FROM c"),
    "point_metrics": sql([*JUDGED, COUNTS, *metrics("c")], f"{METRICS} FROM mx"),
    "metrics_summary": sql([*JUDGED, COUNTS, *metrics("c")], "series_id, format('P={:.3f} R={:.3f} F1={:.3f} FPR={:.3f}', precision, recall, f1, fpr) AS summary FROM mx"),
    "fuzzy_eval": sql([*JUDGED, *fuzzy("j", "fz")], f"{METRICS}, {r('greatest(0.0, 100 - (0.11::double * fp + fn))', 'score')} FROM fz"),
    "detection_delay": sql([*JUDGED, f"b AS (SELECT *, truth = 1 AND coalesce(lag(truth) OVER ({W}), 0) = 0 AS begins, min(CASE WHEN label = 1 THEN idx END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx AS delay FROM j)"], f"series_id, {r('coalesce(avg(delay) FILTER (begins), 0.0)', 'delay_samples')}, {r('coalesce(avg(delay) FILTER (begins), 0.0) / 300', 'delay_seconds')} FROM b GROUP BY series_id"),
    "simple_score": sql([*JUDGED, *SIMPLE], f"series_id, fp, fn, {r('score')} FROM sc"),
    "baseline_rank": sql([*JUDGED, *SIMPLE], f"series_id, {r('score')}, {r('score - 70.5', 'vs_htm')}, {r('score - 51.7', 'vs_rcf')}, {r('score - 35.7', 'vs_skyline')}, (1 + (score < 70.5)::int + (score < 51.7)::int + (score < 35.7)::int + (score < 11.0)::int)::int AS rank FROM sc"),
    "score_contrast": sql([*JUDGED, "a AS (SELECT series_id, avg(score) FILTER (truth = 1) AS inside, avg(score) FILTER (truth = 0) AS outside FROM j GROUP BY series_id)"], f"series_id, {r('inside')}, {r('outside')}, {r('inside / outside', 'contrast')} FROM a"),
    "diagnostic_ratio": sql([*JUDGED, "a AS (SELECT series_id, avg(label) * 100 AS dp, avg(truth) * 100 AS tp FROM j GROUP BY series_id)"], f"series_id, {r('dp', 'detected_percent')}, {r('tp', 'truth_percent')}, {r('coalesce(dp / nullif(tp, 0), 0)', 'ratio')} FROM a"),
    "eval_grid": sql(GRID, f"series_id, algorithm, threshold, {', '.join(map(r, ('precision', 'recall', 'f1')))}, tp, fp, fn FROM grid"),
    "eval_means": sql(MEANS, "algorithm, threshold, avg_precision, avg_recall, avg_f1 FROM means"),
    "eval_categories": sql(GRID, "CASE WHEN series_id IN ('purchase', 'signup') THEN 'sales' ELSE 'other' END AS category, algorithm, threshold, round(avg(precision), 4) AS avg_precision, round(avg(recall), 4) AS avg_recall, round(avg(f1), 4) AS avg_f1 FROM grid GROUP BY ALL"),
    "memory_usage": sql(SERIES, "sum(strlen(series_id) + 24)::bigint AS bytes, format('{:.2f} MB', sum(strlen(series_id) + 24) / 1048576.0::double) AS memory FROM s"),
    "eval_pivot": sql(MEANS, 'algorithm, avg(avg_f1) FILTER (threshold = \'Low\') AS "Low", avg(avg_f1) FILTER (threshold = \'Medium\') AS "Medium" FROM means GROUP BY algorithm'),
    "eval_averages": sql([*GRID, "a AS (SELECT algorithm, avg(precision) AS p, avg(recall) AS rc, avg(f1) AS f, stddev_pop(f1) AS sd FROM grid GROUP BY algorithm)"], f"algorithm, {r('p', 'avg_precision')}, {r('rc', 'avg_recall')}, {r('f', 'avg_f1')}, {r('sd', 'std_f1')}, (row_number() OVER (ORDER BY f DESC, algorithm DESC) = 1)::int AS best FROM a"),
    "synthetic": "SELECT 'synthetic' AS series_id, k AS idx, round(50.0::double + 10.0::double * sqrt(-2.0 * ln(u)) * cos(2.0 * pi() * v), 6) AS value FROM (SELECT k, " + ", ".join(f"(('0x' || substr(md5('42:' || k), {a}, 8))::bigint + 0.5::double) / 4294967296.0::double AS {x}" for a, x in ((1, "u"), (9, "v"))) + " FROM range(10000) t(k))",
    "scalability": f"SELECT (r_regionkey + 1)::int AS cores, {r('100.0 / sqrt(r_regionkey + 1)', 'seconds')}, {r('sqrt(r_regionkey + 1)', 'speedup')}, {r('sqrt(r_regionkey + 1) / (r_regionkey + 1)', 'efficiency')} FROM region",
    "threshold_sweep": sql(SWEEP, f"threshold, {r('raw_score')}, tp, fp, fn FROM sc ORDER BY sc.raw_score DESC, threshold DESC LIMIT 1"),
    "null_perfect_norm": sql([*JUDGED, *fuzzy("j", "fz"), "t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, (SELECT count(*) FROM ix) AS n FROM fz)", "pr AS (SELECT * FROM (VALUES ('standard', 1.0::double, 1.0::double, 0.11::double), ('reward_low_FP', 1.0, 1.0, 0.22), ('reward_low_FN', 1.0, 2.0, 0.11)) x(profile, hit, miss, alarm))", "raw AS (SELECT *, hit * tp - miss * fn - alarm * fp AS raw_score FROM t, pr)"], f"profile, {r('raw_score')}, {r('-miss * n', 'null_raw')}, {r('hit * n', 'perfect_raw')}, {r('(raw_score + miss * n) / (hit * n + miss * n) * 100', 'score')} FROM raw"),
}
for _name in ("iqr", "detection_delay"):
    SQL[f"{_name}_long_series"] = SQL[_name]
SQL["fill_long_series"] = SQL["fill_interpolate"]
for _name, _make in (("zscore", zscore), ("prederr", prederr), ("hybrid", hybrid), ("mean_shift", mean_shift)):
    for _suffix in ("", "_long_series"):
        SQL[f"{_name}_after_drop{_suffix}"] = sql([*DROPPED, *_make("d", "adaptive", 3.0)], f"series_id, idx0 AS idx, d.idx AS pos, {r('score')}, label, detection_type FROM d JOIN s USING (series_id, idx)").replace("d.idx AS pos", "idx AS pos")
for _policy, _method, _v in (("fixed", "fixed", 3.0), ("percentile", "percentile", 97.3), ("adaptive", "adaptive", 3.0)):
    SQL[f"zscore_{_policy}"] = sql([SERIES, *zscore("d", _method, _v)], FOUND)
    SQL[f"prederr_{_policy}"] = sql([SERIES, *prederr("d", _method, _v, 3)], FOUND)
    SQL[f"hybrid_{_policy}"] = sql([SERIES, *hybrid("d", _method, _v)], FOUND)
    SQL[f"mean_shift_{_policy}"] = sql([SERIES, *mean_shift("d", _method, 0.5 if _method == "fixed" else _v)], FOUND)
SQL["rolling_long_series"] = SQL["rolling_trailing"]
for _name in ("zscore", "prederr", "hybrid", "mean_shift"):
    SQL[f"{_name}_long_series"], SQL[f"{_name}_percentile_long_series"] = SQL[f"{_name}_adaptive"], SQL[f"{_name}_percentile"]
SQL["all_detectors_long_series"] = SQL["detect_all"]
