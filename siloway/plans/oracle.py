"""DuckDB SQL with the rows of the queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from siloway.functions import dims
from siloway.functions.dims import PATHS_WITH_DISCHARGE, PATHS_WITHOUT_DISCHARGE, values_sql
from siloway.functions.scalar import ALERT_CATEGORIES, DAY_US, DEFAULT_CATEGORY, HOUR_US, WEEKDAYS
from siloway.plans.queries import DIVISOR, NOW_US, REF_DAY, SITES, WEEK_US
from siloway.sources.adapters import ALERT_TYPES, CIRCUIT_OF, EVENT_OF, SECTORS_OF, TEMPLATES

SQL: dict[str, str] = {}


def q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


TRIPS = f"""trips AS (
  SELECT 'trip-' || event_id AS trip_id, event_id, user_id AS truck_id, 'P' || user_id AS plate, {q(SITES)}[(user_id % 3 + 1)::INT] AS site_id, epoch_us(ts) AS in_us,
    epoch_us(ts) + floor(value * 60000000 + 0.5::DOUBLE)::BIGINT AS out_us, value AS duration_minutes, greatest(30::DOUBLE, least(1440::DOUBLE, coalesce(value, 0::DOUBLE))) AS stay,
    {case(CIRCUIT_OF, 'event_type')} AS circuit, CASE WHEN event_id % 10 < 7 THEN 'VALIDADO' WHEN event_id % 10 < 9 THEN 'CON_OBSERVACIONES' ELSE 'ANOMALO' END AS state,
    string_split({case(SECTORS_OF, 'event_type')}, ' ') AS sectors,
    CASE event_id % 5 WHEN 0 THEN 'soja premium' WHEN 1 THEN 'MAIZ' WHEN 2 THEN 'cebada' END AS product_type,
    DATE '1970-01-01' + ((epoch_us(ts) + floor(value * 60000000 + 0.5::DOUBLE)::BIGINT) // {DAY_US})::INT AS trip_date,
    (epoch_us(ts) // {HOUR_US}) % 24 AS in_hour, ((epoch_us(ts) + floor(value * 60000000 + 0.5::DOUBLE)::BIGINT) // {HOUR_US}) % 24 AS out_hour,
    {REF_DAY} - (epoch_us(ts) + floor(value * 60000000 + 0.5::DOUBLE)::BIGINT) // {DAY_US} AS days_ago
  FROM events)"""

ALERTS = f"""alerts AS (
  SELECT 'alert-' || event_id AS alert_id, event_id, user_id AS truck_id, {q(SITES)}[(user_id % 3 + 1)::INT] AS site_id, epoch_us(ts) AS at_us, {q(ALERT_TYPES)}[(event_id % 9 + 1)::INT] AS alert_type,
    CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 80 THEN 'HIGH' WHEN value > 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    ['OPEN', 'ACKNOWLEDGED', 'RESOLVED'][(event_id % 3 + 1)::INT] AS status, CASE WHEN event_id % 7 <> 0 THEN 'S' || event_id % 11 END AS sector
  FROM events WHERE event_type = 'error')"""

SITE = "sites AS (SELECT * FROM " + values_sql([(s,) for s in SITES], "site_id") + ")"


def capacity(divisor: int = 1) -> str:
    return "capacity AS (SELECT * FROM " + values_sql([(s, k, max(1, c // divisor)) for s, m in dims.CAPACITY.items() for k, c in m.items()], "site_id, sector, capacity") + ")"


def add(name: str, ctes: list[str], body: str) -> None:
    SQL[name] = "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def r(x: str) -> str:
    """Six places; the first rounding takes away what the order of a sum leaves, so that halves are halves in any engine."""
    return f"round(round({x}, 9), 6)"


# --- statistics ----------------------------------------------------------------------------------------------------


def stay_stats(by: str, x: str, source: str) -> list[str]:
    return [
        f"base AS (SELECT {by}, count({x}) AS n, avg({x}) AS mean, coalesce(stddev_samp({x}), 0) AS std, min({x}) AS min, max({x}) AS max, quantile_cont({x}, 0.05) AS p5, quantile_cont({x}, 0.25) AS q1, "
        f"quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, quantile_cont({x}, 0.9) AS p90, quantile_cont({x}, 0.95) AS p95 FROM {source} GROUP BY {by})",
        f"counted AS (SELECT {by}, {x} AS v, count(*) AS c, min(event_id) AS f FROM {source} GROUP BY ALL)",
        f"modes AS (SELECT {by}, v AS mode FROM counted QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY c DESC, f) = 1)",
        f"over_rows AS (SELECT {by}, count(*) FILTER ({x} > mean + 2 * std) AS over_count FROM {source} JOIN base USING ({by}) GROUP BY {by})",
        f"""stay AS (SELECT {by}, n, mean, median, mode, min, max, std, p5, p90, p95, q1, q3, q3 - q1 AS iqr, CASE WHEN mean = 0 THEN 0 ELSE std / mean * 100 END AS cv, mean + 2 * std AS threshold,
  over_count, over_count / n * 100 AS over_pct, abs(mode - median) AS mode_median_gap FROM base JOIN modes USING ({by}) JOIN over_rows USING ({by}))""",
    ]


STAY_COLUMNS = "mean median mode min max std p5 p90 p95 q1 q3 iqr cv threshold over_pct mode_median_gap".split()
for _name, _by, _source in (("stay_time_stats", "site_id", "trips"), ("stats_by_shift", "shift", "shifted")):
    add(
        _name,
        [TRIPS, "shifted AS (SELECT *, CASE WHEN in_hour >= 6 AND in_hour < 14 THEN 'manana' WHEN in_hour >= 14 AND in_hour < 22 THEN 'tarde' ELSE 'noche' END AS shift FROM trips)", *stay_stats(_by, "stay", _source)],
        f"SELECT {_by}, n, over_count, " + ", ".join(f"{r(c)} AS {c}" for c in STAY_COLUMNS) + " FROM stay",
    )

_KIND = "CASE WHEN abs(z) <= 2 THEN 'normal' WHEN abs(z) <= 3 THEN 'alto_desvio' WHEN abs(z) <= 4 THEN 'outlier' ELSE 'extremo' END"


def zed(x: str) -> str:
    return f"m AS (SELECT site_id, avg({x}) AS m, stddev_samp({x}) AS s, count(*) AS n FROM trips GROUP BY 1), z AS (SELECT trips.*, n, CASE WHEN s > 0 THEN ({x} - m) / s ELSE 0 END AS z FROM trips JOIN m USING (site_id))"


add(
    "variability_stats",
    [TRIPS, zed("stay")],
    f"SELECT site_id, {r('coalesce(stddev_samp(stay), 0)')} AS std, {r('CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(stay) / avg(stay) * 100 END')} AS cv, "
    + ", ".join(f"count(*) FILTER ({_KIND} = '{k}') AS {k}_count" for k in ("normal", "alto_desvio", "outlier", "extremo"))
    + " FROM z GROUP BY site_id",
)
add("outliers_zscore", [TRIPS, zed("duration_minutes")], f"SELECT trip_id, site_id, {r('z')} AS z FROM z WHERE abs(z) > 3 AND n >= 3")
add("zscore_class", [TRIPS, zed("duration_minutes")], f"SELECT site_id, {_KIND} AS kind, count(*) AS trips, {r('max(z)')} AS max_z FROM z GROUP BY ALL")
add(
    "mode_first_seen",
    [TRIPS, "c AS (SELECT site_id, circuit, floor(duration_minutes)::BIGINT AS mode, count(*) AS mode_count, min(event_id) AS f FROM trips GROUP BY ALL)"],
    "SELECT site_id, circuit, mode, mode_count FROM c QUALIFY row_number() OVER (PARTITION BY site_id, circuit ORDER BY mode_count DESC, f) = 1",
)
add("percentiles", [TRIPS], "SELECT circuit, " + ", ".join(f"{r(f'quantile_cont(duration_minutes, {p / 100})')} AS p{p}" for p in (5, 25, 50, 75, 90, 95)) + " FROM trips GROUP BY circuit")
add(
    "outliers_iqr",
    [TRIPS, "l AS (SELECT site_id, quantile_cont(duration_minutes, 0.25) AS a, quantile_cont(duration_minutes, 0.75) AS b, count(*) AS n FROM trips GROUP BY 1)"],
    f"SELECT trip_id, site_id, {r('duration_minutes')} AS duration_minutes FROM trips JOIN l USING (site_id) WHERE n >= 4 AND (duration_minutes < a - 1.5 * (b - a) OR duration_minutes > b + 1.5 * (b - a))",
)
add(
    "gaussian_curve",
    [TRIPS, "m AS (SELECT avg(stay) AS m, stddev_samp(stay) AS s FROM trips)"],
    f"SELECT i, {r('m + (-3 + 6 * i / 50::DOUBLE) * s')} AS x, {r('100 * exp(-pow(-3 + 6 * i / 50::DOUBLE, 2) / 2)')} AS y FROM m, range(51) AS t(i) WHERE s > 0",
)
add(
    "kde_curve",
    [
        TRIPS,
        "h AS (SELECT floor(stay) / 60 AS v FROM trips)",
        "m AS (SELECT count(*) AS n, stddev_samp(v) AS s, greatest(0, min(v) - 0.1::DOUBLE) AS a, max(v) + 0.1::DOUBLE AS b FROM h)",
        "w AS (SELECT *, greatest(s * 1.06::DOUBLE * pow(n, -0.2::DOUBLE), s * 0.2::DOUBLE) AS bw, (b - a) / 79 AS step FROM m)",
        "c AS (SELECT v, count(*) AS c FROM h GROUP BY v)",
        "g AS (SELECT i, a + i * step AS x, step, bw, n FROM w, range(80) AS t(i))",
        "k AS (SELECT i, x, step, n, sum(c * exp(-0.5::DOUBLE * pow((x - v) / bw, 2)) / sqrt(2 * pi())) / (n * bw) AS density FROM g, c GROUP BY i, x, step, n, bw)",
        "a AS (SELECT sum(density * CASE WHEN i IN (0, 79) THEN step / 2 ELSE step END) AS area FROM k)",
    ],
    f"SELECT i, {r('x')} AS x, {r('density')} AS density, {r('density * n / area')} AS freq_smoothed FROM k, a",
)
add(
    "histogram_smoothed",
    [TRIPS, "c AS (SELECT least(140, greatest(0, floor((stay / 60 - 0.5::DOUBLE) / (10 / 60::DOUBLE))))::BIGINT AS bin, count(*) AS n FROM trips GROUP BY 1)", "f AS (SELECT b AS bin, coalesce(n, 0) AS count FROM range(141) AS t(b) LEFT JOIN c ON bin = b)"],
    f"SELECT bin, {r('floor((0.5::DOUBLE + (bin + 0.5::DOUBLE) * (10 / 60::DOUBLE)) * 100 + 0.5::DOUBLE) / 100')} AS x, count, {r('avg(count) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS freq_smoothed FROM f",
)
_BIN = "floor(floor(duration_minutes / 5) * 5 * 10 + 0.5::DOUBLE) / 10"
add("histogram_sparse", [TRIPS], f"SELECT site_id, {r(_BIN)} AS bin_start, count(*) AS count FROM trips GROUP BY ALL")
add(
    "binned_mode",
    [TRIPS, f"b AS (SELECT site_id, {_BIN} AS s, count(*) AS count FROM trips GROUP BY ALL)"],
    "SELECT site_id, s + 2.5::DOUBLE AS binned_mode, count FROM b QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY count DESC, s) = 1",
)
SHAPE = [
    "m AS (SELECT site_id, count(*) AS n, avg(duration_minutes) AS m, stddev_samp(duration_minutes) AS s FROM trips GROUP BY 1)",
    "c AS (SELECT site_id, n, greatest(0, m - s) AS central_min, m + s AS central_max, m + s AS tail_limit, count(*) FILTER (duration_minutes BETWEEN greatest(0, m - s) AND m + s) AS central_count, "
    "count(*) FILTER (duration_minutes > m + s) AS tail_count FROM trips JOIN m USING (site_id) GROUP BY ALL)",
    f"b AS (SELECT site_id, {_BIN} AS s, count(*) AS count FROM trips GROUP BY ALL)",
    "pk AS (SELECT site_id, max(count) AS peak FROM b GROUP BY 1)",
    "shape AS (SELECT c.*, peak, peak / n * 100 AS pico_frecuencia_pct, central_count / n * 100 AS en_rango_central_pct, tail_count / n * 100 AS en_cola_derecha_pct FROM c JOIN pk USING (site_id))",
]
_SHAPE = "central_min central_max tail_limit pico_frecuencia_pct en_rango_central_pct en_cola_derecha_pct".split()
add("shape_indicators", [TRIPS, *SHAPE], "SELECT site_id, n, peak, central_count, tail_count, " + ", ".join(f"{r(c)} AS {c}" for c in _SHAPE) + " FROM shape")


def scored(rows: list[tuple], source: str) -> str:
    parts = []
    for metric, low, high, *more in rows:
        up = bool(more and more[0])
        share = f"({metric} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)"
        share = share if up else f"1 - {share}"
        parts.append(f"SELECT site_id, '{metric}' AS metric, {r(metric)} AS value, floor(greatest(0, least(100, 100 * ({share}))) * 10 + 0.5::DOUBLE) / 10 AS score FROM {source}")
    return " UNION ALL ".join(parts)


add(
    "radar_scores",
    [TRIPS, "hours AS (SELECT *, stay / 10 AS h FROM trips)", *stay_stats("site_id", "h", "hours"), "named AS (SELECT *, mode AS moda, median AS mediana FROM stay)"],
    scored(dims.STAY_RADAR, "named"),
)
add("shape_radar_scores", [TRIPS, *SHAPE, "s AS (" + scored(dims.SHAPE_RADAR, "shape") + ")"], f"SELECT site_id, {r('avg(score)')} AS final_score, count(*) AS metrics FROM s GROUP BY site_id")

# --- flow ----------------------------------------------------------------------------------------------------------

FLOW = [
    "spine AS (SELECT site_id, h AS slot FROM sites, range(24) AS t(h))",
    "f AS (SELECT s.site_id, slot, (SELECT count(*) FROM trips t WHERE t.site_id = s.site_id AND in_hour = slot) AS arrivals, (SELECT count(*) FROM trips t WHERE t.site_id = s.site_id AND out_hour = slot) AS departures FROM spine s)",
]
WEEK = [
    "spine AS (SELECT site_id, h AS slot FROM sites, range(168) AS t(h))",
    f"i AS (SELECT site_id, (in_us - {WEEK_US}) // {HOUR_US} AS slot, count(*) AS arrivals FROM trips WHERE in_us >= {WEEK_US} AND in_us < {NOW_US} GROUP BY ALL)",
    f"o AS (SELECT site_id, (out_us - {WEEK_US}) // {HOUR_US} AS slot, count(*) AS departures FROM trips WHERE out_us >= {WEEK_US} AND out_us < {NOW_US} GROUP BY ALL)",
    "f AS (SELECT s.site_id, s.slot, coalesce(arrivals, 0) AS arrivals, coalesce(departures, 0) AS departures FROM spine s LEFT JOIN i USING (site_id, slot) LEFT JOIN o USING (site_id, slot))",
]
BACKLOG = [
    "run AS (SELECT *, arrivals - departures AS net, sum(arrivals - departures) OVER (PARTITION BY site_id ORDER BY slot) AS total FROM f)",
    "flow AS (SELECT site_id, slot, arrivals, departures, net, (total - least(0, min(total) OVER (PARTITION BY site_id)))::BIGINT AS in_plant, total::BIGINT AS total, slot // 24 + 1 AS day, slot % 24 AS hour FROM run)",
]
add("hourly_flow", [TRIPS, SITE, *FLOW, *BACKLOG], "SELECT site_id, slot, arrivals, departures, net, in_plant FROM flow")
add("hourly_flow_week", [TRIPS, SITE, *WEEK, *BACKLOG], "SELECT site_id, slot, arrivals, departures, net, in_plant, day, hour, 'D' || day || ' ' || lpad(hour::VARCHAR, 2, '0') AS label FROM flow")


def crossing(limit: int) -> str:
    return f"(SELECT site_id, count(*) FILTER ((p >= {limit}) <> (in_plant >= {limit})) AS crossings FROM (SELECT *, lag(in_plant) OVER (PARTITION BY site_id ORDER BY slot) AS p FROM flow) GROUP BY 1)"


add("threshold_crossings", [TRIPS, SITE, *WEEK, *BACKLOG], "SELECT * FROM " + crossing(10))
add(
    "flow_saturation_metrics",
    [
        TRIPS, SITE, *WEEK, *BACKLOG,
        "isl AS (SELECT site_id, slot - row_number() OVER (PARTITION BY site_id ORDER BY slot) AS g FROM flow WHERE in_plant > 12)",
        "longest AS (SELECT site_id, max(c) AS recovery_hours FROM (SELECT site_id, g, count(*) AS c FROM isl GROUP BY ALL) GROUP BY 1)",
        "top AS (SELECT site_id, slot AS peak_slot FROM flow QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY in_plant DESC, slot) = 1)",
    ],
    f"""SELECT a.*, recovery_hours, s.crossings AS saturation_crossings, n.crossings AS alert_crossings FROM (
  SELECT site_id, greatest(0, max(in_plant)) AS peak, CASE WHEN max(in_plant) > 0 THEN any_value(peak_slot) ELSE 0 END AS peak_slot, count(*) FILTER (in_plant > 12) AS hours_over, {r('quantile_cont(in_plant, 0.9)')} AS p90, count(*) AS hours,
    greatest(0, max(arrivals)) AS peak_arrivals, greatest(0, max(departures)) AS peak_departures, greatest(0, max(net)) AS max_net, count(*) FILTER (net > 0) AS hours_positive,
    {r('CASE WHEN sum(arrivals) > 0 THEN sum(departures) / sum(arrivals) ELSE 0 END')} AS out_in_ratio, {r('count(*) FILTER (in_plant > 12) / count(*) * 100')} AS pct_over
  FROM flow JOIN top USING (site_id) GROUP BY site_id) a LEFT JOIN longest USING (site_id) JOIN {crossing(12)} s USING (site_id) JOIN {crossing(8)} n USING (site_id)""",
)
add(
    "ingress_kpis",
    [
        TRIPS, SITE, *WEEK, *BACKLOG,
        "pk AS (SELECT site_id, arrivals AS peak_arrivals, CASE WHEN arrivals > 0 THEN slot ELSE 0 END AS peak_slot FROM flow QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY arrivals DESC, slot) = 1)",
        "dd AS (SELECT site_id, day, sum(arrivals)::BIGINT AS n FROM flow GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(arrivals) DESC, day) = 1)",
        "bb AS (SELECT site_id, day, hour // 8 * 8 AS band, sum(arrivals)::BIGINT AS n, count(*) AS hours FROM flow GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(arrivals) DESC, day, hour // 8 * 8) = 1)",
        "up AS (SELECT site_id, slot, in_plant, slot - row_number() OVER (PARTITION BY site_id ORDER BY slot) AS g FROM flow WHERE net > 0)",
        "ri AS (SELECT site_id, min(slot) AS a, max(slot) AS b, arg_max(in_plant, slot) - arg_min(in_plant, slot) AS backlog FROM up GROUP BY site_id, g)",
        "rise AS (SELECT site_id, a, b, backlog FROM ri WHERE backlog > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY backlog DESC, a) = 1)",
        "pre AS (SELECT site_id, 0::BIGINT AS a, slot AS b, total AS backlog FROM flow WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY total DESC, slot) = 1)",
    ],
    f"""SELECT sites.site_id, peak_arrivals, peak_slot, dd.n AS best_day_arrivals,
  CASE WHEN dd.n > 0 THEN {q(WEEKDAYS)}[(({REF_DAY} + 4 - (7 - dd.day)) % 7 + 1)::INT] || ' (D' || dd.day || ')' ELSE '—' END AS best_day,
  CASE WHEN dd.n > 0 THEN {q(WEEKDAYS)}[(({REF_DAY} + 4 - (7 - bb.day)) % 7 + 1)::INT] || ' ' || lpad(band::VARCHAR, 2, '0') || '–' || lpad((band + 8)::VARCHAR, 2, '0') ELSE '—' END AS best_band,
  bb.n AS best_band_arrivals, {r('bb.n / bb.hours')} AS best_band_per_hour, (SELECT {r('avg(arrivals)')} FROM flow WHERE flow.site_id = sites.site_id) AS arrivals_per_hour,
  coalesce(rise.backlog, pre.backlog, 0) AS backlog, CASE WHEN rise.site_id IS NULL THEN pre.a ELSE rise.a END AS backlog_start, CASE WHEN rise.site_id IS NULL THEN pre.b ELSE rise.b END AS backlog_end
FROM sites JOIN pk USING (site_id) JOIN dd USING (site_id) JOIN bb USING (site_id) LEFT JOIN rise USING (site_id) LEFT JOIN pre USING (site_id)""",
)
add(
    "avg_duration_by_hour",
    [TRIPS, SITE, "c AS (SELECT site_id, in_hour AS hour, avg(stay) AS m, count(*) AS n FROM trips GROUP BY ALL)"],
    f"SELECT s.site_id, h AS hour, {r('coalesce(m, 0)')} AS mean_stay, coalesce(n, 0) AS trips FROM (SELECT site_id, h FROM sites, range(24) AS t(h)) s LEFT JOIN c ON c.site_id = s.site_id AND c.hour = h",
)
add("daily_stay_mean", [TRIPS], f"SELECT site_id, trip_date::VARCHAR AS trip_date, {r('avg(stay)')} AS mean_stay, count(*) AS trips FROM trips GROUP BY ALL")
add("duration_scatter", [TRIPS], f"SELECT trip_id, site_id, plate, {r('((in_us // 1000000) % 86400)::DOUBLE / 3600')} AS hour, {r('stay')} AS stay FROM trips")
add(
    "bucket_flow_series",
    [TRIPS, SITE.replace("(SELECT * FROM", "(SELECT t.* FROM"), *WEEK],
    "SELECT site_id, slot, arrivals, departures, arrivals - departures AS net, sum(arrivals - departures) OVER (PARTITION BY site_id ORDER BY slot)::BIGINT AS cumulative FROM f WHERE site_id IN (SELECT site_id FROM trips)",
)

_END = NOW_US - 20 * 60_000_000


def arrivals(end: int, step: int) -> str:
    return f"coalesce((SELECT n FROM (SELECT (in_us - {WEEK_US}) // {step} AS k, count(*) AS n FROM trips WHERE in_us >= {WEEK_US} AND in_us < {end} GROUP BY 1) WHERE k = bucket), 0) AS arrivals"


add(
    "time_buckets",
    [TRIPS, f"b AS (SELECT b AS bucket, {WEEK_US} + b * {HOUR_US // 2} AS start_us FROM range({-(-(_END - WEEK_US) // (HOUR_US // 2))}) AS t(b))"],
    f"SELECT bucket, start_us, least({_END}, start_us + {HOUR_US // 2}) AS end_us, {q(WEEKDAYS)}[dayofweek(make_timestamp(start_us)) + 1] AS weekday, strftime(make_timestamp(start_us), '%H:%M') AS label, hour(make_timestamp(start_us)) % 6 = 0 AS tick, {arrivals(_END, HOUR_US // 2)} FROM b",
)
add(
    "deterministic_deviates",
    [TRIPS],
    f"SELECT trip_id, {r('sin(event_id * 9999) * 10000 - floor(sin(event_id * 9999) * 10000)')} AS uniform, {r('sqrt(-2 * ln((event_id % 97 + 1) / 98)) * cos(6.283185307179586::DOUBLE * ((event_id % 89) / 89))')} AS normal FROM trips",
)

# --- density and saturation ----------------------------------------------------------------------------------------

INTERVALS = [
    """w0 AS (SELECT trip_id, site_id, in_us, out_us, sectors, CASE WHEN out_us > in_us THEN out_us - in_us ELSE (stay * 60000000)::BIGINT END AS span,
  list_transform(sectors, lambda s: CASE WHEN event_id % 4 <> 0 THEN 0 WHEN s = 'S1' THEN 1 + event_id % 7 WHEN s = 'S4' THEN 2 + event_id % 5 ELSE 0 END::DOUBLE) AS raw FROM trips)""",
    "w1 AS (SELECT *, CASE WHEN list_sum(raw) > 0 THEN list_transform(raw, lambda w: CASE WHEN w > 0 THEN w * len(list_filter(raw, lambda k: k > 0)) ELSE list_sum(raw) END) ELSE list_transform(raw, lambda w: 1::DOUBLE) END AS weights FROM w0)",
    "w2 AS (SELECT *, unnest(range(len(sectors))) AS step FROM w1)",
    """seg AS (SELECT trip_id, site_id, sectors[step + 1] AS sector, step, in_us + floor(span * coalesce(list_sum(weights[1:step]), 0) / list_sum(weights))::BIGINT AS start_us,
  in_us + floor(span * list_sum(weights[1:step + 1]) / list_sum(weights))::BIGINT AS end_us, out_us, in_us FROM w2)""",
    "iv AS (SELECT trip_id, site_id, sector, step, start_us, end_us, in_us, out_us FROM seg WHERE end_us > start_us)",
]
WEEK_IV = f"wk AS (SELECT site_id, sector, greatest(start_us, {WEEK_US}) AS start_us, least(end_us, {NOW_US}) AS end_us FROM iv WHERE out_us > {WEEK_US} AND in_us < {NOW_US} AND least(end_us, {NOW_US}) > greatest(start_us, {WEEK_US}))"


def sweep(source: str, by: str) -> list[str]:
    return [
        f"ch AS (SELECT {by}, at_us, sum(d) AS d FROM (SELECT {by}, start_us AS at_us, 1 AS d FROM {source} UNION ALL SELECT {by}, end_us, -1 FROM {source}) GROUP BY ALL)",
        f"occ AS (SELECT {by}, at_us, sum(d) OVER (PARTITION BY {by} ORDER BY at_us)::BIGINT AS occupied FROM ch)",
    ]


EPISODES = [
    "st AS (SELECT occ.*, capacity::BIGINT AS capacity, coalesce(lag(occupied) OVER (PARTITION BY site_id, sector ORDER BY at_us), 0) AS was FROM occ JOIN capacity USING (site_id, sector))",
    "isl AS (SELECT *, count(*) FILTER (occupied > capacity AND was <= capacity) OVER (PARTITION BY site_id, sector ORDER BY at_us) AS g FROM st WHERE occupied > capacity OR was > capacity)",
    """ep AS (SELECT site_id, sector, capacity, min(at_us) AS start_us, max(at_us) FILTER (occupied <= capacity) AS end_us, max(occupied) FILTER (occupied > capacity) AS max_occupancy FROM isl GROUP BY site_id, sector, capacity, g HAVING count(*) FILTER (occupied <= capacity) > 0)""",
]
_EPISODE = f"""SELECT site_id, sector, start_us, end_us, {r('(end_us - start_us) / 60000000')} AS minutes, max_occupancy, capacity, max_occupancy - capacity AS max_excess,
  {r('max_occupancy / capacity * 100')} AS max_utilization_pct, CASE WHEN max_occupancy / capacity * 100 >= 120 THEN 'severe' ELSE 'moderate' END AS severity FROM ep"""
WEEK_EP = [TRIPS, *INTERVALS, WEEK_IV, capacity(DIVISOR), *sweep("wk", "site_id, sector"), *EPISODES]
add("sector_intervals", [TRIPS, *INTERVALS], "SELECT trip_id, site_id, sector, step, start_us, end_us FROM iv")
add("saturation_episodes", WEEK_EP, _EPISODE)
add("saturation_episodes_full_capacity", [TRIPS, *INTERVALS, capacity(), *sweep("iv", "site_id, sector"), *EPISODES], _EPISODE)
add(
    "sector_density",
    [
        TRIPS, ALERTS, *INTERVALS, capacity(), *sweep("iv", "site_id, sector"),
        "pk AS (SELECT site_id, sector, max(occupied) AS peak FROM occ GROUP BY ALL)",
        "th AS (SELECT site_id, sector, count(*) AS trips, avg(stay) AS mean_stay FROM (SELECT DISTINCT iv.trip_id, iv.site_id, iv.sector, stay FROM iv JOIN trips USING (trip_id)) GROUP BY ALL)",
        "al AS (SELECT site_id, sector, count(*) AS alerts FROM alerts WHERE sector IS NOT NULL GROUP BY ALL)",
        "keys AS (SELECT site_id, sector FROM pk UNION SELECT site_id, sector FROM th UNION SELECT site_id, sector FROM al)",
    ],
    f"""SELECT site_id, sector, coalesce(peak, 0) AS peak, coalesce(trips, 0) AS trips, {r('coalesce(mean_stay, 0)')} AS mean_stay, coalesce(alerts, 0) AS alerts, capacity::BIGINT AS capacity, coalesce(coalesce(peak, 0) >= capacity, false) AS saturated
FROM keys LEFT JOIN pk USING (site_id, sector) LEFT JOIN th USING (site_id, sector) LEFT JOIN al USING (site_id, sector) LEFT JOIN capacity USING (site_id, sector)""",
)
HEAT = [
    f"tb AS (SELECT *, unnest(range((start_us - {WEEK_US}) // {HOUR_US}, (end_us - 1 - {WEEK_US}) // {HOUR_US} + 1)) AS bucket FROM wk)",
    f"tc AS (SELECT site_id, sector, bucket, greatest(start_us, {WEEK_US} + bucket * {HOUR_US}) AS start_us, least(end_us, {WEEK_US} + (bucket + 1) * {HOUR_US}) AS end_us FROM tb)",
    "hc AS (SELECT site_id, sector, bucket, at_us, sum(d) AS d FROM (SELECT site_id, sector, bucket, start_us AS at_us, 1 AS d FROM tc UNION ALL SELECT site_id, sector, bucket, end_us, -1 FROM tc) GROUP BY ALL)",
    "ho AS (SELECT site_id, sector, bucket, max(o) AS occupancy FROM (SELECT *, sum(d) OVER (PARTITION BY site_id, sector, bucket ORDER BY at_us)::BIGINT AS o FROM hc) GROUP BY ALL)",
    "heat AS (SELECT s.site_id, s.sector, b AS bucket, coalesce(occupancy, 0) AS occupancy, capacity::BIGINT AS capacity, coalesce(occupancy, 0) / capacity AS u "
    "FROM (SELECT DISTINCT site_id, sector FROM wk) s CROSS JOIN range(168) AS t(b) LEFT JOIN ho ON ho.site_id = s.site_id AND ho.sector = s.sector AND ho.bucket = b LEFT JOIN capacity c ON c.site_id = s.site_id AND c.sector = s.sector)",
    "cells AS (SELECT *, CASE WHEN u IS NULL THEN 'normal' WHEN u >= 1.2::DOUBLE THEN 'severe' WHEN u > 1 THEN 'saturated' WHEN u >= 0.8::DOUBLE THEN 'high' ELSE 'normal' END AS band FROM heat)",
]
add("saturation_heatmap", [TRIPS, *INTERVALS, WEEK_IV, capacity(DIVISOR), *HEAT], f"SELECT site_id, sector, bucket, occupancy, capacity, {r('u')} AS utilization, band FROM cells")
SUMMARY = [
    *WEEK_EP, *HEAT,
    "bm AS (SELECT site_id, sector, count(*) FILTER (band IN ('saturated', 'severe')) * 60::DOUBLE AS bucket_minutes FROM cells GROUP BY ALL)",
    "tot AS (SELECT site_id, sector, count(*) AS episodes, sum(end_us - start_us)::BIGINT AS us, max(end_us - start_us) / 60000000 AS longest, max(max_occupancy - capacity) AS max_excess FROM ep GROUP BY ALL)",
    f"hr AS (SELECT site_id, sector, (start_us // {HOUR_US}) % 24 AS hour, sum(end_us - start_us) AS us, min(start_us) AS f FROM ep GROUP BY ALL)",
    "cr AS (SELECT site_id, sector, hour FROM hr QUALIFY row_number() OVER (PARTITION BY site_id, sector ORDER BY us DESC, f) = 1)",
    """summ AS (SELECT site_id, sector, coalesce(episodes, 0) AS episodes, coalesce(us, 0) / 60000000 AS saturated_minutes, coalesce(longest, 0) AS longest_minutes, coalesce(max_excess, 0) AS max_excess, bucket_minutes,
  CASE WHEN hour IS NULL THEN '—' ELSE lpad(hour::VARCHAR, 2, '0') || ':00–' || lpad(((hour + 1) % 24)::VARCHAR, 2, '0') || ':00' END AS critical_hour FROM bm LEFT JOIN tot USING (site_id, sector) LEFT JOIN cr USING (site_id, sector))""",
]
add(
    "sector_summaries",
    SUMMARY,
    f"""SELECT site_id, sector, episodes, {r('saturated_minutes')} AS saturated_minutes, {r('longest_minutes')} AS longest_minutes, max_excess, bucket_minutes, critical_hour,
  CASE WHEN episodes = 0 THEN 'sin_saturacion' WHEN saturated_minutes >= 240 OR episodes >= 8 OR max_excess >= 10 THEN 'critico' WHEN saturated_minutes >= 60 OR episodes >= 3 OR max_excess >= 4 THEN 'alto' ELSE 'moderado' END AS status FROM summ""",
)
EXEC = "ex AS (SELECT site_id, count(*) FILTER (episodes > 0) AS saturated_sectors, sum(episodes)::BIGINT AS episodes, sum(saturated_minutes) AS saturated_minutes, max(saturated_minutes) / 60 AS top_sector_hours FROM summ GROUP BY 1)"
TOP = "tp AS (SELECT site_id, sector AS top_sector, episodes AS top_episodes, saturated_minutes AS top_minutes FROM summ WHERE episodes > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY round(saturated_minutes, 6) DESC, episodes DESC, max_excess DESC, CASE WHEN regexp_matches(sector, '^S[0-9]+$') THEN sector[2:]::INT ELSE 10000 END) = 1)"
add("saturation_executive", [*SUMMARY, EXEC, TOP], f"SELECT site_id, saturated_sectors, episodes, {r('saturated_minutes')} AS saturated_minutes, top_sector, {r('top_sector_hours')} AS top_sector_hours FROM ex LEFT JOIN tp USING (site_id)")
PAIRS = "pr AS (SELECT a.site_id, a.sector AS sector_a, b.sector AS sector_b, count(*) AS overlap_count FROM ep a JOIN ep b ON a.site_id = b.site_id AND a.sector < b.sector AND a.start_us < b.end_us AND b.start_us < a.end_us GROUP BY ALL)"
add("simultaneous_episodes", [*WEEK_EP, PAIRS], "SELECT * FROM pr")
add(
    "detail_window",
    WEEK_EP,
    f"SELECT site_id, sector, start_us, greatest({WEEK_US}, start_us - greatest(2 * (end_us - start_us), {4 * HOUR_US})) AS window_start, least({NOW_US}, end_us + greatest(2 * (end_us - start_us), {4 * HOUR_US})) AS window_end FROM ep",
)
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(alert_type, '{p}', 'i') THEN '{n}'" for p, n in ALERT_CATEGORIES) + f" ELSE '{DEFAULT_CATEGORY}' END"
add("operational_markers", [ALERTS], f"SELECT alert_id, site_id, at_us, {_CATEGORY} AS category, alert_type, sector FROM alerts WHERE at_us >= {WEEK_US} AND at_us < {NOW_US} AND (sector IS NULL OR sector = 'S4')")
add("alert_category", [ALERTS], f"SELECT {_CATEGORY} AS category, count(*) AS alerts FROM alerts GROUP BY 1")
add(
    "saturation_narrative",
    [
        *SUMMARY, TOP, PAIRS,
        f"hh AS (SELECT site_id, (start_us // {HOUR_US}) % 24 AS hour FROM ep GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(end_us - start_us) DESC, (start_us // {HOUR_US}) % 24) = 1)",
        "bp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY pr.overlap_count DESC, sector_a DESC, sector_b DESC) = 1)",
    ],
    """SELECT site_id, 1::BIGINT AS rule, top_sector || ' fue el sector más comprometido: ' || top_episodes || ' episodio(s) y ' || printf('%.1f', top_minutes / 60) || ' h con ocupación por encima de la capacidad.' AS sentence FROM tp
UNION ALL SELECT site_id, 2, 'La mayor concentración de minutos saturados se observa alrededor de las ' || lpad(hour::VARCHAR, 2, '0') || ':00 (según inicio de episodios).' FROM hh
UNION ALL SELECT site_id, 3, 'Se observa solapamiento temporal de episodios de saturación entre ' || sector_a || ' y ' || sector_b || '.' FROM bp""",
)

# --- routes --------------------------------------------------------------------------------------------------------

_rows, _seen = [], {}
for _site, _code, _eq, _n, _kind, _sub, _seq in dims.CIRCUITS:
    _seen[_site] = _seen.get(_site, -1) + 1
    _rows.append((_site, _seen[_site], _code, _eq, _n, f"{_kind}-{_sub}", _seq and _seq.split(" ")))
CIRCUITS = "circuits AS (SELECT * FROM " + values_sql(_rows, "site_id, ordinal, code, equivalents, circuit_name, operation, sequence") + ")"
LOOKUP = [
    CIRCUITS,
    "norm AS (SELECT *, regexp_replace(upper(trim(circuit)), '^([EB])0', '\\1') AS n FROM (SELECT DISTINCT site_id, circuit FROM trips))",
    """lk AS (SELECT norm.site_id, circuit, code AS circuit_code, circuit_name, operation FROM norm JOIN circuits c ON c.site_id = norm.site_id AND (code = n OR list_contains(equivalents, n) OR list_contains(equivalents, coalesce(nullif(regexp_extract(n, '^([A-Z][0-9]+)', 1), ''), n)))
  QUALIFY row_number() OVER (PARTITION BY norm.site_id, circuit ORDER BY ordinal) = 1)""",
    """hashed AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(trip_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM trips)""",
    """lu AS (SELECT t.*, circuit_code, circuit_name, operation, CASE WHEN coalesce(product_type, '') = '' THEN ['Soja', 'Maíz', 'Girasol', 'Trigo'][(h % 4 + 1)::INT] WHEN contains(lower(product_type), 'soja') THEN 'Soja' WHEN contains(lower(product_type), 'maíz') THEN 'Maíz'
  WHEN contains(lower(product_type), 'girasol') THEN 'Girasol' WHEN contains(lower(product_type), 'trigo') THEN 'Trigo' ELSE upper(product_type[1]) || product_type[2:] END AS product FROM hashed t LEFT JOIN lk USING (site_id, circuit))""",
]
LU = [TRIPS, *LOOKUP]
add("circuit_lookup", LU, "SELECT trip_id, site_id, circuit, circuit_code, circuit_name, operation FROM lu")
add(
    "classify_by_sequence",
    [
        TRIPS, CIRCUITS,
        "sq AS (SELECT DISTINCT site_id, sectors FROM trips)",
        "pr AS (SELECT sq.site_id, sectors, ordinal, code, sequence, list_reduce(list_prepend(0, list_transform(sectors, lambda s: list_position(sequence, s))), lambda j, p: CASE WHEN p = j + 1 THEN j + 1 ELSE j END) AS m FROM sq JOIN circuits c ON c.site_id = sq.site_id AND sequence IS NOT NULL)",
        "sc AS (SELECT *, sectors = sequence AS exact, CASE WHEN m = len(sequence) THEN len(sequence)::DOUBLE ELSE m / len(sequence) END AS score FROM pr WHERE m > 0)",
        "bs AS (SELECT site_id, sectors, code, exact, score FROM sc QUALIFY row_number() OVER (PARTITION BY site_id, sectors ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE score END DESC, ordinal) = 1)",
    ],
    "SELECT t.site_id, circuit, CASE WHEN exact OR score >= 0.6 THEN code END AS sequence_code, count(*) AS trips FROM trips t LEFT JOIN bs ON bs.site_id = t.site_id AND bs.sectors = t.sectors GROUP BY ALL",
)
_STATES = f"count(*) AS trips, count(*) FILTER (state = 'VALIDADO') AS complete, count(*) FILTER (state = 'CON_OBSERVACIONES') AS varied, count(*) FILTER (state NOT IN ('VALIDADO', 'CON_OBSERVACIONES')) AS anomalous, count(*) FILTER (state IN ('VALIDADO', 'CON_OBSERVACIONES')) AS valid, {r('count(*) FILTER (state NOT IN (' + chr(39) + 'VALIDADO' + chr(39) + ', ' + chr(39) + 'CON_OBSERVACIONES' + chr(39) + ')) / count(*) * 100')} AS anomalous_pct"
add("kpi5_classification", [TRIPS], f"SELECT site_id, {_STATES} FROM trips GROUP BY site_id")
add("kpi5_security", LU, f"SELECT site_id, {_STATES}, count(*) FILTER (state NOT IN ('VALIDADO', 'CON_OBSERVACIONES')) * 26 AS anomalous_tonnes FROM lu WHERE product = 'Soja' GROUP BY site_id")
add(
    "kpi5_operations",
    [*LU, "ops AS (SELECT * FROM " + values_sql(dims.OPERATIONS, "operation, operation_name") + ")"],
    "SELECT s.site_id, ops.operation, operation_name, (SELECT count(*) FROM lu WHERE lu.site_id = s.site_id AND lu.operation = ops.operation AND state <> 'ANOMALO') AS trips FROM (SELECT DISTINCT site_id FROM trips) s, ops",
)
add(
    "kpi5_destinations_topn",
    [*LU, "c AS (SELECT site_id, operation, circuit_name AS d, count(*) AS n, row_number() OVER (PARTITION BY site_id, operation ORDER BY count(*) DESC, circuit_name) AS rk, sum(count(*)) OVER (PARTITION BY site_id, operation) AS total FROM lu WHERE state <> 'ANOMALO' AND operation IS NOT NULL GROUP BY 1, 2, 3)"],
    f"SELECT site_id, operation, CASE WHEN rk <= 1 THEN d ELSE 'Otros' END AS destination, sum(n)::BIGINT AS trips, {r('sum(n) / any_value(total) * 100')} AS pct FROM c GROUP BY ALL",
)
add(
    "kpi5_multilevel",
    [*LU, "c AS (SELECT site_id, coalesce(circuit_name, 'Sin clasificar') AS d, count(*) AS n, row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, coalesce(circuit_name, 'Sin clasificar')) AS rk FROM lu WHERE state = 'VALIDADO' GROUP BY 1, 2)"],
    """SELECT site_id, 'estado' AS level, CASE WHEN state = 'ANOMALO' THEN 'anomalos' ELSE 'validos' END AS name, count(*) AS trips FROM lu GROUP BY ALL
UNION ALL SELECT site_id, 'producto', product, count(*) FROM lu WHERE state = 'ANOMALO' GROUP BY ALL UNION ALL SELECT site_id, 'destino', CASE WHEN rk <= 2 THEN d ELSE 'Otros' END, sum(n)::BIGINT FROM c GROUP BY ALL""",
)
add("product_labels", LU, "SELECT product, count(*) AS trips FROM lu GROUP BY 1")
add("product_options", LU, "SELECT DISTINCT product FROM lu UNION ALL SELECT 'Todos'")
add("duration_by_plant_circuit", [TRIPS], f"SELECT site_id, coalesce(circuit, 'N/A') AS circuit, {r('avg(stay)')} AS mean_stay, count(*) AS trips FROM trips GROUP BY ALL")
add("historical_valid_bars", LU, "SELECT site_id, operation, circuit_name AS destination, count(*) AS trips, array_to_string(list_sort(list(DISTINCT circuit_code)), ',') AS codes FROM lu WHERE state <> 'ANOMALO' AND operation IS NOT NULL GROUP BY 1, 2, 3")

# --- visits --------------------------------------------------------------------------------------------------------

_N = len(TEMPLATES)
GATE = [
    f"""tpl AS (SELECT o_orderkey AS k, o_custkey AS c, {q(TEMPLATES)}[(o_orderkey % {_N} + 1)::INT] AS path, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 24 + o_orderkey % 24) * 3600000000 + 1800000000 AS start FROM orders)""",
    "steps AS (SELECT *, unnest(range(length(path))) AS step FROM tpl)",
    f"""ge AS (SELECT {q(SITES)}[(c % 3 + 1)::INT] AS site_id, CASE WHEN k % 9 <> 0 THEN 'v' || k END AS visit_id, 'P' || c AS plate, 'D' || k AS doc_number, start + step * 300000000 AS at_us, path[step + 1] AS letter,
  CASE WHEN path[step + 1] = 'C' AND step = length(path) - strpos(reverse(path), 'C') THEN CASE WHEN contains(path, 'D') <> (k % 11 = 0) THEN 'OK' ELSE 'NO' END WHEN path[step + 1] = 'C' THEN 'OBS' END AS result FROM steps)""",
]


def bucket(hours: int) -> str:
    return f"strftime(make_timestamp((at_us // {hours * HOUR_US}) * {hours * HOUR_US}), '%Y-%m-%dT%H')"


def keyed(fallback: int) -> str:
    return f"ky AS (SELECT *, CASE WHEN visit_id IS NOT NULL THEN site_id || '|' || visit_id || '|' || {bucket(12)} ELSE site_id || '|' || plate || '|' || doc_number || '|' || {bucket(fallback)} END AS visit_key FROM ge)"


_NAME = case({v: k for k, v in {e: letter for letter, e in EVENT_OF.items()}.items()}, "letter")
VISITS = [
    *GATE, keyed(2),
    f"nm AS (SELECT *, {case(EVENT_OF, 'letter')} AS event, row_number() OVER (PARTITION BY visit_key ORDER BY at_us) AS pos, count(*) FILTER (letter = 'C') OVER (PARTITION BY visit_key ORDER BY at_us) AS nc, count(*) FILTER (letter = 'D') OVER (PARTITION BY visit_key ORDER BY at_us) AS nd FROM ky)",
    """vi AS (SELECT visit_key, min(site_id) AS site_id, min(plate) AS plate, bool_or(visit_id IS NULL) AS fb, string_agg(letter, '' ORDER BY at_us) FILTER (NOT (letter = 'C' AND nc > 3) AND NOT (letter = 'D' AND nd > 2)) AS path, string_agg(letter, '' ORDER BY at_us) AS letters,
  list(result ORDER BY at_us) FILTER (result IS NOT NULL) AS results, count(*) FILTER (letter = 'B') AS nb, count(*) FILTER (letter = 'E') AS ne, count(*) FILTER (letter = 'F') AS nf, min(at_us) AS a_us, max(at_us) AS z_us,
  min(at_us) FILTER (letter = 'A') AS checkin, min(at_us) FILTER (letter = 'F') AS exit_us, min(at_us) FILTER (letter = 'C') AS sample_us, min(at_us) FILTER (letter = 'G') AS g1, max(at_us) FILTER (letter = 'G') AS g2, count(*) FILTER (letter = 'G') AS ng, list(event || '@' || at_us ORDER BY at_us) AS told FROM nm GROUP BY visit_key)""",
    "vp AS (SELECT *, CASE WHEN contains(path, 'C') THEN results[length(path) - length(replace(path, 'C', ''))] END AS last_result, contains(path, 'D') AS has_d FROM vi)",
    f"""vf AS (SELECT *, list_filter([CASE WHEN path[1] <> 'A' THEN 'MISSING_EVENT' END, CASE WHEN NOT contains(path, 'B') AND (contains(path, 'C') OR has_d OR contains(path, 'E')) THEN 'MISSING_EVENT' END, CASE WHEN NOT contains(path, 'C') THEN 'MISSING_EVENT' END,
  CASE WHEN path[-1] <> 'F' THEN 'OPEN_TRIP' END, CASE WHEN has_d AND last_result IS DISTINCT FROM 'OK' THEN 'D_WITHOUT_OK' END, CASE WHEN NOT has_d AND last_result = 'OK' THEN 'D_WITHOUT_OK' END, CASE WHEN NOT list_contains({q(PATHS_WITH_DISCHARGE + PATHS_WITHOUT_DISCHARGE)}, path) THEN 'INVALID_PATH' END,
  CASE WHEN has_d AND last_result IS NULL THEN 'NO_CALADA_RESULT' END, CASE WHEN regexp_matches(path, 'D.*G.*E') OR regexp_matches(path, 'G.*G.*G') THEN 'WAIT_SUSPICIOUS' END, CASE WHEN nb > 1 OR ne > 1 OR nf > 1 THEN 'DUPLICATE_EVENT' END], lambda f: f IS NOT NULL) AS base_flags FROM vp)""",
    """vs AS (SELECT *, CASE WHEN len(base_flags) > 0 THEN 'INVALID' WHEN path = 'ABCDEF' THEN 'VALID_IDEAL' WHEN has_d THEN 'VALID_ACCEPTABLE' ELSE 'VALID_NO_DISCHARGE' END AS status, array_to_string(string_split(path, ''), '-') AS path_display,
  CASE WHEN fb THEN list_append(base_flags, 'VISIT_KEY_FALLBACK_USED') ELSE base_flags END AS flags FROM vf)""",
    "vb AS (SELECT *, CASE status WHEN 'VALID_IDEAL' THEN 'PERFECT' WHEN 'INVALID' THEN 'INVALID' ELSE 'VALID' END AS bucket FROM vs)",
]
add("visit_keys", [*GATE, keyed(2)], "SELECT visit_key, visit_id IS NULL AS key_fallback, count(*) AS events FROM ky GROUP BY ALL")
add("visit_paths", VISITS, "SELECT visit_key, path, last_result FROM vp")
add("trip_validation", VISITS, "SELECT visit_key, site_id, plate, path, path_display, status, array_to_string(flags, ',') AS flags FROM vs")
add("trip_flags", VISITS, "SELECT flag, status, count(*) AS visits FROM (SELECT unnest(flags) AS flag, status FROM vs) GROUP BY ALL")
_TOLD = {"GATE_CHECKIN": "Ingreso", "SCALE_IN": "Pesaje entrada", "SAMPLE_SOLID_TAKEN": "Calada", "DISCHARGE_END": "Fin descarga", "SCALE_OUT": "Pesaje salida", "EXIT": "Egreso", "YARD_WAIT": "Espera"}
add(
    "trip_story",
    [*VISITS, f"st AS (SELECT visit_key, string_agg({case({k: _TOLD[e] for k, e in EVENT_OF.items()}, 'letter')} || ' ' || strftime(make_timestamp(at_us), '%H:%M:%S'), ' -> ' ORDER BY at_us) AS story FROM ky GROUP BY 1)"],
    """SELECT visit_key, story, CASE status WHEN 'INVALID' THEN 'Recorrido inválido: ' || array_to_string(base_flags, ', ') || '. Secuencia: ' || path_display || '.' WHEN 'VALID_IDEAL' THEN 'Recorrido ideal sin esperas. Secuencia: ' || path_display || '.'
  WHEN 'VALID_ACCEPTABLE' THEN 'Recorrido aceptable (con espera y/o re-calada). Secuencia: ' || path_display || '.' ELSE 'Recorrido sin descarga (calada NO). Secuencia: ' || path_display || '.' END AS explanation FROM vs JOIN st USING (visit_key)""",
)
add(
    "visit_status_metrics",
    [v if not v.startswith("ky AS") else keyed(12) for v in VISITS],
    """SELECT visit_key, CASE WHEN exit_us IS NOT NULL THEN 'CLOSED' ELSE 'OPEN' END AS visit_status, CASE WHEN exit_us IS NOT NULL THEN greatest(1, (z_us - a_us) // 60000000) ELSE (z_us - a_us) // 60000000 END AS cycle_minutes,
  (sample_us - checkin) // 60000000 AS to_sample_minutes, CASE WHEN ng >= 2 THEN (g2 - g1) // 60000000 END AS yard_minutes,
  array_to_string(list_filter([CASE WHEN NOT contains(letters, 'C') AND contains(letters, 'D') THEN 'SAMPLE_SOLID_TAKEN' END, CASE WHEN contains(letters, 'E') AND NOT contains(letters, 'B') THEN 'SCALE_IN' END], lambda m: m IS NOT NULL), ',') AS missing_steps FROM vi""",
)
SCATTER = "sc AS (SELECT visit_key, site_id, plate, (checkin % 86400000000) // 60000000 AS entry_minute, greatest(1, (exit_us - checkin) // 60000000) AS stay_minutes, bucket, path AS path_key FROM vb WHERE checkin IS NOT NULL AND exit_us IS NOT NULL AND bucket <> 'INVALID')"
add("visit_scatter", [*VISITS, SCATTER], "SELECT * FROM sc")
add("visit_scatter_stats", [*VISITS, SCATTER], f"SELECT {r('quantile_cont(stay_minutes, 0.5)')} AS p50, {r('quantile_cont(stay_minutes, 0.95)')} AS p95, count(*) AS n FROM sc")
add("visit_pie", VISITS, "SELECT b AS bucket, (SELECT count(*) FROM vb WHERE bucket = b AND exit_us IS NOT NULL) AS visits FROM (SELECT unnest(['PERFECT', 'VALID', 'INVALID']) AS b)")
add("visit_paths_bar", VISITS, "SELECT path AS path_key, count(*) AS visits FROM vb WHERE status <> 'INVALID' GROUP BY 1")
add("visits_by_bucket", VISITS, "SELECT visit_key, status FROM vb WHERE bucket = 'PERFECT'")
add(
    "sim_nodes",
    [*GATE, keyed(2), "nn AS (SELECT visit_key, letter, at_us, lag(letter) OVER (PARTITION BY visit_key ORDER BY at_us) AS p FROM ky)"],
    "SELECT visit_key, row_number() OVER (PARTITION BY visit_key ORDER BY at_us) - 1 AS ordinal, letter AS node FROM nn WHERE p IS DISTINCT FROM letter",
)

# --- state and pages -----------------------------------------------------------------------------------------------

READS = [
    """cs AS (SELECT *, CASE WHEN event_id % 17 = 3 THEN list_filter(sectors, lambda s: s <> 'S4') WHEN event_id % 17 = 5 THEN flatten(list_transform(sectors, lambda s: CASE WHEN s = 'S4' THEN [s, s] ELSE [s] END)) WHEN event_id % 17 = 7 THEN sectors[1:2] ELSE sectors END AS seq FROM trips)""",
    "rs AS (SELECT *, unnest(range(len(seq))) AS step FROM cs)",
    "reads AS (SELECT trip_id, truck_id, plate, site_id, circuit, step, seq[step + 1] AS sector, 'CAM_' || seq[step + 1] AS camera_id, in_us + ((out_us - in_us) * step) // len(seq) AS at_us FROM rs)",
]
STATE = [
    *READS,
    """tt AS (SELECT trip_id, any_value(cs.truck_id) AS truck_id, any_value(cs.site_id) AS site_id, any_value(seq) AS visited, any_value(sectors) AS expected, min(at_us) AS s_us, max(at_us) AS e_us FROM cs JOIN reads USING (trip_id) GROUP BY trip_id)""",
    """ts2 AS (SELECT *, visited[-1] = expected[-1] AS complete, NOT list_contains(visited, 'S4') AS no_s4, CASE WHEN list_contains(list_transform(range(1, len(visited)), lambda i: visited[i] = visited[i + 1]), true) THEN 'S4' END AS dbl, greatest(0, floor((e_us - s_us) / 60000000 + 0.5::DOUBLE))::BIGINT AS minutes FROM tt)""",
]
add(
    "truck_state",
    [TRIPS, *STATE],
    "SELECT trip_id, site_id, complete, CASE WHEN no_s4 OR dbl IS NOT NULL THEN 'ANOMALO' WHEN complete THEN 'VALIDADO' ELSE 'CON_OBSERVACIONES' END AS classification, minutes, visited[-1] AS current_sector, array_to_string(visited, ' ') AS visited FROM ts2",
)
add(
    "state_alerts",
    [TRIPS, *STATE, f"sl AS (SELECT *, greatest(0, floor(({NOW_US} - e_us) / 60000000 + 0.5::DOUBLE))::BIGINT AS silent FROM ts2)"],
    """SELECT trip_id, 1::BIGINT AS ordinal, 'critical_camera_missing' AS alert_type, 'high' AS severity, 'No se detecto paso por el nodo critico S4.' AS message FROM sl WHERE no_s4
UNION ALL SELECT trip_id, 2, 'unexpected_double_pass', 'medium', 'Doble paso consecutivo por ' || dbl || '.' FROM sl WHERE dbl IS NOT NULL
UNION ALL SELECT trip_id, 3, 'incomplete_route', 'medium', 'Recorrido aun no completo segun secuencia esperada.' FROM sl WHERE NOT complete
UNION ALL SELECT trip_id, 4, 'truck_disappeared', 'high', 'Sin detecciones de camara por ' || silent || ' minutos.' FROM sl WHERE NOT complete AND silent >= 60""",
)
add(
    "trucks_in_plant",
    [TRIPS, *STATE],
    f"SELECT trip_id, site_id, visited[-1] AS current_sector, len(visited) AS reads, s_us AS first_us, e_us AS last_us, 'CAM_' || visited[-1] AS last_camera FROM ts2 WHERE NOT complete AND visited[-1] NOT IN ('S3', 'S10') AND e_us >= {NOW_US - 16 * HOUR_US}",
)
add("enrich_camera_events", [TRIPS, *READS], "SELECT trip_id, step, camera_id, sector, truck_id, at_us FROM reads")
add(
    "home_summary",
    [TRIPS, ALERTS, SITE, *STATE, "ac AS (SELECT * FROM ts2 WHERE NOT complete)"],
    """SELECT site_id, (SELECT count(*) FROM ac WHERE ac.site_id = s.site_id) AS active_trucks, (SELECT count(*) FROM alerts a WHERE a.site_id = s.site_id AND status <> 'RESOLVED' AND EXISTS (SELECT 1 FROM ac WHERE ac.truck_id = a.truck_id AND ac.site_id = a.site_id)) AS active_alerts,
  (SELECT count(*) FROM trips t WHERE t.site_id = s.site_id AND days_ago = 0) AS closed FROM sites s""",
)
for _name, _n, _slot, _keep in (("day", 24, "out_hour", "days_ago = 0"), ("week", 7, "6 - days_ago", "days_ago BETWEEN 0 AND 6"), ("month", 4, "3 - least(3, days_ago // 7)", "days_ago BETWEEN 0 AND 30")):
    add(
        f"home_activity_{_name}",
        [TRIPS],
        "SELECT b AS slot, " + ", ".join(f"(SELECT count(*) FROM trips WHERE {_keep} AND {_slot} = b AND site_id = '{s}') AS {s}" for s in SITES) + f" FROM range({_n}) AS t(b)",
    )
add("home_classification", [TRIPS], f"SELECT period, site_id, {_STATES} FROM trips JOIN (VALUES ('day', 0), ('week', 7), ('month', 30)) AS p(period, days) ON days_ago BETWEEN 0 AND days GROUP BY ALL")
add(
    "home_alerts",
    [ALERTS],
    "SELECT site_id, severity, " + ", ".join(f"count(*) FILTER ({NOW_US} - at_us <= {n * DAY_US}) AS {name}" for name, n in (("day", 1), ("week", 7), ("month", 30))) + f" FROM alerts WHERE status <> 'RESOLVED' AND at_us <= {NOW_US} GROUP BY ALL",
)
PEAK = [*INTERVALS, *sweep("iv", "site_id, sector"), "ps AS (SELECT site_id, sector AS top_sector FROM (SELECT site_id, sector, max(occupied) AS p FROM occ GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY p DESC, sector DESC) = 1)"]
add(
    "plant_comparison",
    [TRIPS, ALERTS, SITE, *PEAK, f"sh AS (SELECT site_id, {_STATES}, avg(duration_minutes) AS m, coalesce(stddev_samp(duration_minutes), 0) / avg(duration_minutes) * 100 AS c FROM trips GROUP BY 1)"],
    f"SELECT s.site_id, coalesce(trips, 0) AS trips, coalesce(anomalous_pct, 0) AS anomalous_pct, {r('coalesce(m, 0)')} AS mean_minutes, {r('coalesce(c, 0)')} AS cv, top_sector, (SELECT count(*) FROM alerts a WHERE a.site_id = s.site_id AND severity = 'CRITICAL' AND status <> 'RESOLVED') AS critical_open FROM sites s LEFT JOIN sh USING (site_id) LEFT JOIN ps USING (site_id)",
)
add("plant_flow", [TRIPS, SITE, *FLOW, *BACKLOG], "SELECT site_id, sum(arrivals)::BIGINT AS arrivals, sum(departures)::BIGINT AS departures, max(in_plant) AS max_in_plant FROM flow GROUP BY 1")
add(
    "committee_insights",
    [
        TRIPS, ALERTS, SITE, *PEAK, *FLOW, *BACKLOG,
        "sl AS (SELECT site_id, circuit AS slowest_circuit FROM trips GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY avg(duration_minutes) DESC, circuit DESC) = 1)",
        "ph AS (SELECT site_id, slot AS peak_hour FROM flow QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY arrivals + departures DESC, slot) = 1)",
        f"sh AS (SELECT site_id, {_STATES} FROM trips GROUP BY 1)",
    ],
    f"SELECT site_id, anomalous_pct, {r('varied / trips * 100')} AS observed_pct, slowest_circuit, top_sector, peak_hour, (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL' AND status <> 'RESOLVED') AS critical_open FROM sh JOIN sl USING (site_id) JOIN ps USING (site_id) JOIN ph USING (site_id)",
)
add("alerts_filtered", [ALERTS], "SELECT alert_id, status, sector FROM alerts WHERE site_id = 'san_lorenzo' AND status <> 'RESOLVED' AND severity = 'HIGH'")
add("alert_counts", [ALERTS], "SELECT site_id, count(*) FILTER (status <> 'RESOLVED') AS open, count(*) FILTER (status <> 'RESOLVED' AND severity = 'CRITICAL') AS critical, count(*) FILTER (status = 'RESOLVED') AS resolved FROM alerts GROUP BY 1")
add("alert_deviations", [ALERTS], "SELECT alert_id, alert_type FROM alerts WHERE status <> 'RESOLVED' AND alert_type IN ('FUERA_CIRCUITO', 'CONFLICTO_CIRCUITO_CAMARA', 'EXCESO_TIEMPO_SECTOR', 'SIN_ACTUALIZACION')")
add("trips_with_alerts_semi", [TRIPS, ALERTS], "SELECT trip_id, truck_id FROM trips WHERE truck_id IN (SELECT truck_id FROM alerts WHERE status <> 'RESOLVED' AND alert_type IN ('FUERA_CIRCUITO', 'CONFLICTO_CIRCUITO_CAMARA'))")
_MONTH = "trip_date >= DATE '2024-01-01' AND trip_date < DATE '2024-02-01'"
add(
    "historical_period_filter",
    [TRIPS],
    " UNION ALL ".join(
        f"SELECT '{n}' AS period, site_id, count(*) AS trips FROM trips WHERE {c} GROUP BY site_id"
        for n, c in (
            ("day", "days_ago = 0"), ("week", "days_ago BETWEEN 0 AND 6"), ("month", _MONTH), ("week-day", "days_ago = 2"),
            ("month-week", f"{_MONTH} AND date_diff('day', trip_date, DATE '2024-01-31') BETWEEN 7 AND 13"), ("rolling", "days_ago BETWEEN 0 AND 30"),
        )
    ),
)
add("overlapping_trips", [TRIPS], f"SELECT trip_id, in_us, out_us FROM trips WHERE out_us > {WEEK_US} AND in_us < {WEEK_US + HOUR_US}")
add("plate_search", [TRIPS], "SELECT plate, count(*) AS trips FROM trips WHERE contains(lower(plate), 'p1') GROUP BY 1")
add("latest_reads", [TRIPS, *READS], "SELECT trip_id, step, at_us, camera_id FROM reads ORDER BY at_us DESC, trip_id, step LIMIT 48")
add("iso_week_archive", [TRIPS], "SELECT site_id, isoyear(trip_date) || '-W' || lpad(weekofyear(trip_date)::VARCHAR, 2, '0') AS iso_week, strftime(trip_date, '%Y-%m') AS month, count(*) AS trips FROM trips GROUP BY ALL")
add("retention_cap", [TRIPS], "SELECT trip_id, site_id, out_us FROM trips QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY out_us DESC, trip_id DESC) <= 700")
add(
    "scatter_offset",
    [TRIPS, "h AS (SELECT trip_id, site_id, ((in_us // 1000000) % 86400)::DOUBLE / 3600 AS x FROM trips)"],
    f"SELECT trip_id, {r('x + least(0.08::DOUBLE, (row_number() OVER (PARTITION BY site_id, floor(x * 100) ORDER BY trip_id) - 1) * 0.008::DOUBLE)')} AS x_shown FROM h",
)
add(
    "text_codes",
    [TRIPS],
    "SELECT trip_id, 'CIR_' || circuit || '_V0,VUE_A1_V2' AS codes, CASE WHEN event_id % 12 <= 10 AND event_id % 12 <> 4 THEN 'S4,S' || event_id % 12 ELSE 'S4' END AS sectors FROM trips",
)
