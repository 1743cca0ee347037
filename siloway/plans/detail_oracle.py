"""DuckDB SQL with the rows of ``detail_queries``, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from siloway.functions import dims
from siloway.functions.dims import values_sql
from siloway.functions.scalar import DAY_US, HOUR_US, WEEKDAYS
from siloway.operators.detail import DEFAULT_REFERENCE_US, TOLD_CATEGORIES
from siloway.plans.oracle import (
    _BIN, _CATEGORY, _EPISODE, _STATES, ALERTS, BACKLOG, CIRCUITS, EXEC, FLOW, GATE, INTERVALS, LU, PAIRS, READS, SHAPE, SITE, SQL, STATE, STAY_COLUMNS, SUMMARY, TOP, TRIPS, VISITS, WEEK, WEEK_EP, add, arrivals, bucket, capacity, case, q, r, scored, stay_stats, sweep,
)
from siloway.plans.queries import DIVISOR, MONTH_US, NOW_US, REF_DAY, WEEK_US
from siloway.sources.adapters import EVENT_OF

__all__ = ["SQL"]

# --- reference days and periods ------------------------------------------------------------------------------------

REFS = f"refs AS (SELECT s.site_id, coalesce(max(out_us), {DEFAULT_REFERENCE_US}) AS max_out_us, coalesce(max(out_us), {DEFAULT_REFERENCE_US}) // {DAY_US} AS ref_day FROM sites s LEFT JOIN trips t USING (site_id) GROUP BY 1)"
add("reference_days", [TRIPS, SITE, REFS], "SELECT * FROM refs")
add(
    "reference_ranges",
    [TRIPS, SITE, REFS],
    f"SELECT site_id, period, (ref_day + 1 - n) * {DAY_US} AS start_us, (ref_day + 1) * {DAY_US} AS end_us FROM refs, (VALUES ('last_day', 1), ('last_week', 7), ('last_month', 30)) AS p(period, n)",
)
add("week_of_own_reference", [TRIPS, SITE, REFS], f"SELECT t.site_id, count(*) AS trips, max(out_us) AS last_us FROM trips t JOIN refs USING (site_id) WHERE ref_day - out_us // {DAY_US} BETWEEN 0 AND 6 GROUP BY 1")
add(
    "historical_scatter_x",
    [TRIPS, "h AS (SELECT trip_id, days_ago AS b, floor(((in_us // 1000000) % 86400)::DOUBLE / 3600 * 100 + 0.5::DOUBLE) / 100 AS h FROM trips WHERE days_ago BETWEEN 0 AND 30)"],
    f"SELECT trip_id, {r('h')} AS x_day, {r('greatest(1, least(7, 7 - b)) + h / 24')} AS x_week, {r('greatest(1, least(5, 5 - b // 7)) + (b % 7) / 7 + h / 24 / 7')} AS x_month FROM h",
)
add("trips_newest_first", [TRIPS], f"SELECT trip_id, site_id, out_us, row_number() OVER (PARTITION BY site_id ORDER BY out_us DESC, trip_id) AS position FROM trips")
add(
    "deviations_newest_first",
    [ALERTS],
    f"SELECT alert_id, site_id, at_us, row_number() OVER (PARTITION BY site_id ORDER BY at_us DESC, alert_id) AS position FROM alerts WHERE status <> 'RESOLVED' AND alert_type IN ('FUERA_CIRCUITO', 'CONFLICTO_CIRCUITO_CAMARA')",
)

# --- details of saturation -----------------------------------------------------------------------------------------

_ORDER = "(end_us - start_us) DESC, start_us, CASE WHEN regexp_matches(sector, '^S[0-9]+$') THEN sector[2:]::INT ELSE 10000 END"


def selected(by: str) -> str:
    margin = f"greatest(2 * (end_us - start_us), {4 * HOUR_US})"
    return f"sel AS (SELECT site_id, sector, start_us, end_us, capacity, greatest({WEEK_US}, start_us - {margin}) AS a, least({NOW_US}, end_us + {margin}) AS b FROM ep QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {_ORDER}) = 1)"


SERIES = [
    f"sb AS (SELECT site_id, sector, capacity, a, b, unnest(range((b - a - 1) // {HOUR_US} + 1)) AS bucket FROM sel)",
    f"si AS (SELECT i.site_id, i.sector, sel.a, greatest(i.start_us, sel.a) AS s, least(i.end_us, sel.b) AS e FROM iv i JOIN sel ON sel.site_id = i.site_id AND sel.sector = i.sector AND i.start_us < sel.b AND i.end_us > sel.a WHERE i.out_us > {WEEK_US} AND i.in_us < {NOW_US})",
    f"sx AS (SELECT site_id, sector, a, s, e, unnest(range((s - a) // {HOUR_US}, (e - 1 - a) // {HOUR_US} + 1)) AS bucket FROM si)",
    f"sc AS (SELECT site_id, sector, bucket, at_us, sum(d) AS d FROM (SELECT site_id, sector, bucket, greatest(s, a + bucket * {HOUR_US}) AS at_us, 1 AS d FROM sx UNION ALL SELECT site_id, sector, bucket, least(e, a + (bucket + 1) * {HOUR_US}), -1 FROM sx) GROUP BY ALL)",
    "so AS (SELECT site_id, sector, bucket, max(o)::BIGINT AS occupancy FROM (SELECT *, sum(d) OVER (PARTITION BY site_id, sector, bucket ORDER BY at_us) AS o FROM sc) GROUP BY ALL)",
    f"""series AS (SELECT sb.site_id, sb.sector, sb.bucket, a + sb.bucket * {HOUR_US} AS start_us, least(b, a + (sb.bucket + 1) * {HOUR_US}) AS end_us, coalesce(occupancy, 0) AS occupancy, capacity,
  (SELECT count(*) FROM trips t WHERE t.site_id = sb.site_id AND t.in_us >= a + sb.bucket * {HOUR_US} AND t.in_us < least(b, a + (sb.bucket + 1) * {HOUR_US})) AS arrivals,
  (SELECT count(*) FROM trips t WHERE t.site_id = sb.site_id AND t.out_us >= a + sb.bucket * {HOUR_US} AND t.out_us < least(b, a + (sb.bucket + 1) * {HOUR_US})) AS departures FROM sb LEFT JOIN so USING (site_id, sector, bucket))""",
]
add("detail_window_series", [*WEEK_EP, selected("site_id, sector"), *SERIES], "SELECT *, arrivals - departures AS net, sum(arrivals - departures) OVER (PARTITION BY site_id, sector ORDER BY bucket)::BIGINT AS cumulative FROM series")
add(
    "detail_marker_buckets",
    [*WEEK_EP, ALERTS, selected("site_id, sector")],
    f"SELECT sel.site_id, sel.sector, (at_us - a) // {HOUR_US} AS bucket, count(*) AS markers FROM sel JOIN alerts m ON m.site_id = sel.site_id AND at_us >= a AND at_us < b AND (m.sector IS NULL OR m.sector = sel.sector) GROUP BY ALL",
)
add(
    "bucket_day_headers",
    [TRIPS, f"b AS (SELECT b AS bucket, {WEEK_US} + b * {6 * HOUR_US} AS start_us FROM range({(NOW_US - WEEK_US) // (6 * HOUR_US)}) AS t(b))"],
    f"SELECT bucket, start_us, {q(WEEKDAYS)}[dayofweek(make_timestamp(start_us)) + 1] AS weekday, bucket % 4 = 0 AS new_day, {arrivals(NOW_US, 6 * HOUR_US)} FROM b",
)
_NUMBER = "CASE WHEN regexp_matches(sector, '^S[0-9]+$') THEN sector[2:]::INT ELSE 10000 END"
add("ranked_summaries", SUMMARY, f"SELECT site_id, sector, episodes, row_number() OVER (PARTITION BY site_id ORDER BY round(saturated_minutes, 6) DESC, episodes DESC, max_excess DESC, {_NUMBER}) AS position FROM summ")
NAMES = "names AS (SELECT * FROM " + values_sql([(s, k, dims.SITE_SECTOR_NAMES.get(s, {}).get(k, n)) for s, _ in dims.SITES for k, n in dims.SECTOR_NAMES.items()], "site_id, sector, sector_name") + ")"
_STATUS = "CASE WHEN episodes = 0 THEN 'sin_saturacion' WHEN saturated_minutes >= 240 OR episodes >= 8 OR max_excess >= 10 THEN 'critico' WHEN saturated_minutes >= 60 OR episodes >= 3 OR max_excess >= 4 THEN 'alto' ELSE 'moderado' END"
_KEYS = {"sector": f"{_NUMBER} ASC", "nombre": "coalesce(sector_name, sector) DESC", "capacity": "coalesce(capacity, -1) DESC", "critical": "critical_hour DESC", "excess": "max_excess DESC", "status": f"{_STATUS} DESC"}
add(
    "sector_table",
    [*SUMMARY, NAMES, "tb2 AS (SELECT summ.*, sector_name, capacity FROM summ LEFT JOIN names USING (site_id, sector) LEFT JOIN capacity USING (site_id, sector))"],
    " UNION ALL ".join(f"SELECT site_id, sector, sector_name, '{k}' AS sort_key, row_number() OVER (PARTITION BY site_id ORDER BY {o}, {_NUMBER}, sector) AS position FROM tb2" for k, o in _KEYS.items()),
)
add("timeline_order", SUMMARY, f"SELECT site_id, sector, row_number() OVER (PARTITION BY site_id ORDER BY episodes DESC, saturated_minutes DESC, {_NUMBER}) AS position FROM summ")
add(
    "committee_sectors",
    [
        TRIPS, ALERTS, *INTERVALS,
        "th AS (SELECT site_id, sector, count(DISTINCT trip_id) AS trips FROM iv GROUP BY ALL)",
        "keys AS (SELECT site_id, sector FROM th UNION SELECT site_id, sector FROM alerts WHERE sector IS NOT NULL)",
        f"ps2 AS (SELECT site_id, sector, coalesce(trips, 0) AS trips, row_number() OVER (PARTITION BY site_id ORDER BY {_NUMBER}, sector) AS position FROM keys LEFT JOIN th USING (site_id, sector))",
    ],
    "SELECT * FROM ps2 WHERE position <= 8",
)
add(
    "saturation_reading",
    [
        *SUMMARY, ALERTS, PAIRS, EXEC, TOP, selected("site_id"), *SERIES,
        f"hh AS (SELECT site_id, (start_us // {HOUR_US}) % 24 AS hour FROM ep GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(end_us - start_us) DESC, (start_us // {HOUR_US}) % 24) = 1)",
        "rs2 AS (SELECT s.site_id FROM series s JOIN sel USING (site_id) WHERE arrivals > departures AND s.start_us >= sel.start_us AND s.start_us < sel.end_us GROUP BY 1 HAVING count(*) >= 2)",
        f"kd AS (SELECT site_id, list_filter({q(TOLD_CATEGORIES)}, lambda c: list_contains(k, c)) AS told FROM (SELECT site_id, list(DISTINCT {_CATEGORY}) AS k FROM alerts WHERE at_us >= {WEEK_US} AND at_us < {NOW_US} GROUP BY 1))",
        "bp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY pr.overlap_count DESC, sector_a DESC, sector_b DESC) = 1)",
        """ln AS (SELECT site_id, 1 AS rule, top_sector || ' fue el sector más comprometido: ' || top_episodes || ' episodio(s) y ' || printf('%.1f', top_minutes / 60) || ' h con ocupación por encima de la capacidad.' AS sentence FROM tp
UNION ALL SELECT site_id, 1, 'No se detectaron episodios de saturación (ocupación simultánea por encima de capacidad) en el período analizado.' FROM ex WHERE site_id NOT IN (SELECT site_id FROM tp)
UNION ALL SELECT site_id, 2, 'La mayor concentración de minutos saturados se observa alrededor de las ' || lpad(hour::VARCHAR, 2, '0') || ':00 (según inicio de episodios).' FROM hh
UNION ALL SELECT site_id, 3, 'En el episodio seleccionado, en varias franjas consecutivas los ingresos superan a los egresos; se observa junto con el tramo saturado.' FROM rs2
UNION ALL SELECT site_id, 4, 'En el período analizado coinciden alertas de tipo: ' || array_to_string(told, ', ') || '; no implica causalidad directa con la saturación.' FROM kd WHERE len(told) > 0 AND site_id IN (SELECT site_id FROM ep)
UNION ALL SELECT site_id, 5, 'Se observa solapamiento temporal de episodios de saturación entre ' || sector_a || ' y ' || sector_b || '.' FROM bp)""",
        "la2 AS (SELECT * FROM ln UNION ALL SELECT 'sin_viajes', 6, 'No hay datos suficientes para generar lectura automática en este período.')",
    ],
    "SELECT * FROM (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY rule) AS position, sentence FROM la2) WHERE position <= 5",
)
_RANGE = f"trips WHERE out_us > {WEEK_US} AND in_us < {NOW_US}"
add(
    "saturation_analysis",
    [*SUMMARY, EXEC, TOP],
    f"""SELECT site_id, saturated_sectors, episodes, top_sector, (SELECT count(*) FROM trips t WHERE t.site_id = ex.site_id AND out_us > {WEEK_US} AND in_us >= {WEEK_US} AND in_us < {NOW_US}) AS arrivals,
  (SELECT count(*) FROM trips t WHERE t.site_id = ex.site_id AND out_us > {WEEK_US} AND in_us < {NOW_US} AND out_us < {NOW_US}) AS departures FROM ex LEFT JOIN tp USING (site_id) WHERE site_id IN (SELECT site_id FROM {_RANGE})""",
)

# --- statistics ----------------------------------------------------------------------------------------------------

_SHAPE = "central_min central_max tail_limit pico_frecuencia_pct en_rango_central_pct en_cola_derecha_pct".split()


def shaped(x: str, source: str, bins: str, low: str, high: str, tail: str) -> list[str]:
    return [
        f"m AS (SELECT site_id, count({x}) AS n, avg({x}) AS m, stddev_samp({x}) AS s, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, quantile_cont({x}, 0.9) AS p90 FROM {source} GROUP BY 1)",
        f"lim AS (SELECT site_id, n, {low} AS central_min, {high} AS central_max, {tail} AS tail_limit FROM m)",
        f"c AS (SELECT site_id, n, central_min, central_max, tail_limit, count(*) FILTER ({x} BETWEEN central_min AND central_max) AS central_count, count(*) FILTER ({x} > tail_limit) AS tail_count FROM {source} JOIN lim USING (site_id) GROUP BY ALL)",
        f"b AS (SELECT site_id, {bins} AS s, count(*) AS count FROM {source} GROUP BY ALL)",
        "pk AS (SELECT site_id, max(count) AS peak FROM b GROUP BY 1)",
        "shape AS (SELECT c.*, peak, peak / n * 100 AS pico_frecuencia_pct, central_count / n * 100 AS en_rango_central_pct, tail_count / n * 100 AS en_cola_derecha_pct FROM c JOIN pk USING (site_id))",
    ]


_SHAPED = "SELECT site_id, n, peak, central_count, tail_count, " + ", ".join(f"{r(c)} AS {c}" for c in _SHAPE) + " FROM shape"
add("shape_indicators_manual", [TRIPS, *shaped("duration_minutes", "trips", _BIN, "q1", "q3", "90::DOUBLE")], _SHAPED)
add("shape_indicators_p90", [TRIPS, *shaped("duration_minutes", "trips", _BIN, "greatest(0, m - s)", "m + s", "p90")], _SHAPED)
add(
    "histogram_overlay",
    [TRIPS, *SHAPE],
    f"SELECT site_id, b.s AS bin_start, count, {r('peak * exp(-0.5::DOUBLE * pow((b.s - m.m) / m.s, 2))')} AS normal, CASE WHEN b.s BETWEEN central_min AND central_max THEN 'central' WHEN b.s > tail_limit THEN 'cola' ELSE 'resto' END AS kind FROM b JOIN shape USING (site_id) JOIN m USING (site_id)",
)
BAR = "bar AS (SELECT * FROM trips WHERE days_ago BETWEEN 0 AND 30 AND state = 'VALIDADO' AND circuit IN ('A1', 'E1V2', 'E1'))"
add("scatter_of_bar", [TRIPS, BAR], "SELECT trip_id, site_id, circuit FROM bar")
add(
    "page_durations",
    [
        TRIPS, BAR, "h AS (SELECT site_id, stay / 60 AS h FROM bar)", "bb AS (SELECT site_id, floor(floor(h / 0.1::DOUBLE) * 0.1::DOUBLE * 10 + 0.5::DOUBLE) / 10 AS bin, count(*) AS c FROM h GROUP BY ALL)",
        "mo AS (SELECT site_id, bin + 0.05::DOUBLE AS mode FROM bb QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY c DESC, bin) = 1)",
    ],
    f"SELECT site_id, count(*) AS n, {r('avg(h)')} AS mean, {r('coalesce(stddev_samp(h), 0)')} AS std, {r('quantile_cont(h, 0.5)')} AS median, {r('any_value(mode)')} AS mode FROM h JOIN mo USING (site_id) GROUP BY site_id",
)
add(
    "page_duration_kde",
    [
        TRIPS, BAR,
        "h AS (SELECT floor(stay) / 60 AS v FROM bar)",
        "m AS (SELECT count(*) AS n, stddev_samp(v) AS s, greatest(0, min(v) - 0.15::DOUBLE) AS a, max(v) + 0.15::DOUBLE AS b FROM h)",
        "w AS (SELECT *, greatest(s * 1.06::DOUBLE * pow(n, -0.2::DOUBLE), s * 0.2::DOUBLE) AS bw, (b - a) / 99 AS step FROM m)",
        "c AS (SELECT v, count(*) AS c FROM h GROUP BY v)",
        "g AS (SELECT i, a + i * step AS x, step, bw, n FROM w, range(100) AS t(i))",
        "k AS (SELECT i, x, step, n, sum(c * exp(-0.5::DOUBLE * pow((x - v) / bw, 2)) / sqrt(2 * pi())) / (n * bw) AS density FROM g, c GROUP BY i, x, step, n, bw)",
        "a AS (SELECT sum(density * CASE WHEN i IN (0, 99) THEN step / 2 ELSE step END) AS area FROM k)",
    ],
    f"SELECT i, {r('x')} AS x, {r('density')} AS density, {r('density * n / area')} AS freq_smoothed FROM k, a",
)


def _radar(start: int) -> str:
    return "SELECT * FROM (WITH " + ",\n".join([f"hours AS (SELECT *, stay / 10 AS h FROM trips WHERE out_us >= {start})", *stay_stats("site_id", "h", "hours"), "named AS (SELECT *, mode AS moda, median AS mediana FROM stay)"]) + " " + scored(dims.STAY_RADAR, "named") + ")"


add("radar_merged", [TRIPS, f"ra AS ({_radar(WEEK_US)})", f"rb AS ({_radar(MONTH_US)})"], "SELECT ra.*, rb.score AS score_compare FROM ra LEFT JOIN rb USING (site_id, metric)")
_HALF = "floor(floor(h / 0.5::DOUBLE) * 0.5::DOUBLE * 10 + 0.5::DOUBLE) / 10"
add(
    "stay_reading",
    [
        TRIPS, "hours AS (SELECT *, stay / 60 AS h FROM trips)", *stay_stats("site_id", "h", "hours"), *shaped("h", "hours", _HALF, "greatest(0, m - s)", "m + s", "m + s"),
        "mo AS (SELECT site_id, s + 0.25::DOUBLE AS mode FROM b QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY count DESC, s) = 1)",
        """said AS (SELECT stay.site_id, ['La mayor concentración de camiones se ubica alrededor de ' || printf('%.1f', mo.mode) || ' h, con un pico estimado de ' || replace(format('{:,}', peak), ',', '.') || ' camiones.',
  'El ' || printf('%.0f', en_rango_central_pct) || '% de los camiones se encuentra dentro del rango central esperado.', 'El ' || printf('%.0f', en_cola_derecha_pct) || '% de los camiones se ubica en la cola derecha de la distribución.',
  'El 90% de los camiones egresa antes de ' || printf('%.1f', stay.p90) || ' horas.', 'El 50% central de la operación se mueve dentro de un rango de ' || printf('%.1f', iqr) || ' horas (' || printf('%.1f', stay.q1) || '–' || printf('%.1f', stay.q3) || ' h).',
  CASE WHEN mode_median_gap < 0.5 THEN 'La distancia entre moda y mediana sugiere una distribución estable y coherente.' WHEN mode_median_gap < 1.5 THEN 'La distancia entre moda y mediana indica una ligera asimetría en la distribución.'
  ELSE 'La distancia entre moda y mediana sugiere una distribución sesgada o mezcla de comportamientos.' END] AS l FROM stay JOIN shape USING (site_id) JOIN mo USING (site_id))""",
    ],
    "SELECT site_id, i::BIGINT AS position, l[i + 1] AS sentence FROM (SELECT *, unnest(range(6)) AS i FROM said)",
)

add(
    "stay_reading_short",
    [
        TRIPS, "hours AS (SELECT *, stay / 60 AS h FROM trips)", *stay_stats("site_id", "h", "hours"),
        """said AS (SELECT site_id, ['La mayor concentración de camiones se ubica alrededor de ' || printf('%.1f', stay.mode) || ' horas.', 'El 90% de los camiones egresa antes de ' || printf('%.1f', p90) || ' horas.',
  'El 50% central de la operación se mueve dentro de un rango de ' || printf('%.1f', iqr) || ' horas (' || printf('%.1f', q1) || '–' || printf('%.1f', q3) || ' h).',
  CASE WHEN mode_median_gap < 0.5 THEN 'La distancia entre moda y mediana sugiere una distribución estable y coherente.' WHEN mode_median_gap < 1.5 THEN 'La distancia entre moda y mediana indica una ligera asimetría en la distribución.'
  ELSE 'La distancia entre moda y mediana sugiere una distribución sesgada o mezcla de comportamientos.' END] AS l FROM stay)""",
    ],
    "SELECT site_id, i::BIGINT AS position, l[i + 1] AS sentence FROM (SELECT *, unnest(range(4)) AS i FROM said) UNION ALL SELECT 'sin_viajes', 0, 'No hay datos suficientes para generar conclusiones.'",
)

# --- flow ----------------------------------------------------------------------------------------------------------

add("flow_points_week", [TRIPS, SITE, *WEEK, *BACKLOG], "SELECT site_id, slot, 'D' || day || ' ' || lpad(hour::VARCHAR, 2, '0') AS label, in_plant, arrivals, departures, net, hour, day FROM flow")
add("flow_points_day", [TRIPS, SITE, *FLOW, *BACKLOG], "SELECT site_id, slot, lpad(slot::VARCHAR, 2, '0') AS label, in_plant, arrivals, departures, net, slot AS hour, NULL::BIGINT AS day FROM flow")
add("arrival_peaks", [TRIPS, SITE, *WEEK, *BACKLOG], "SELECT site_id, slot, 'D' || day || ' ' || lpad(hour::VARCHAR, 2, '0') AS label, arrivals FROM flow WHERE arrivals > 0 QUALIFY arrivals = max(arrivals) OVER (PARTITION BY site_id)")


def _slot(x: str) -> str:
    return f"'D' || ({x} // 24 + 1) || ' ' || lpad(({x} % 24)::VARCHAR, 2, '0')"


add(
    "flow_reading",
    [
        f"fm AS (SELECT * FROM ({SQL['flow_saturation_metrics']}))", f"ik AS (SELECT * FROM ({SQL['ingress_kpis']}))",
        f"""ls AS (SELECT fm.site_id, list_filter([
  CASE WHEN peak > 0 THEN 'La planta alcanzó un pico de ' || replace(format('{{:,}}', peak), ',', '.') || ' camiones en planta a las ' || {_slot('fm.peak_slot')} || '.' END,
  CASE WHEN hours_over > 0 THEN 'Se registraron ' || hours_over || ' horas por encima del umbral de saturación (' || printf('%.1f', pct_over) || '% del tiempo).' END,
  CASE WHEN p90 > 0 AND peak > 0 AND p90 / peak >= 0.9 THEN 'El P90 (' || floor(p90 + 0.5)::BIGINT || ') está cerca del pico (' || peak || '): la planta pasa buena parte del tiempo cerca del límite.' END,
  CASE WHEN alert_crossings > 0 OR saturation_crossings > 0 THEN 'Se atravesó el umbral ' || concat_ws(' y ', CASE WHEN alert_crossings > 0 THEN alert_crossings || ' cruces del umbral de alerta' END, CASE WHEN saturation_crossings > 0 THEN saturation_crossings || ' cruces del umbral de saturación' END) || '.' END,
  CASE WHEN ik.peak_arrivals > 0 THEN 'El mayor pico de llegadas fue de ' || ik.peak_arrivals || ' camiones/h (' || {_slot('ik.peak_slot')} || ').' END,
  CASE WHEN best_day_arrivals > 0 THEN 'El día con más ingresos fue ' || best_day || ' con ' || replace(format('{{:,}}', best_day_arrivals), ',', '.') || ' camiones entrando.' END,
  CASE WHEN best_band <> '—' AND best_band_arrivals > 0 THEN 'La franja crítica (8h con más llegadas) es ' || best_band || ': ' || best_band_arrivals || ' camiones (' || printf('%.1f', best_band_per_hour) || ' cam/h). Promedio general: ' || printf('%.1f', arrivals_per_hour) || ' cam/h.' END,
  CASE WHEN backlog > 0 THEN 'Backlog: +' || backlog || ' camiones acumulados (' || {_slot('backlog_start')} || '–' || {_slot('backlog_end')} || '). Ocurre cuando entran más camiones de los que salen.' END,
  CASE WHEN coalesce(recovery_hours, 0) > 0 THEN 'El episodio de saturación más largo duró ' || recovery_hours || ' horas.' END], lambda s: s IS NOT NULL) AS l FROM fm JOIN ik USING (site_id))""",
        "lf AS (SELECT site_id, CASE WHEN len(l) > 0 THEN l ELSE ['No hay datos suficientes para generar conclusiones.'] END AS l FROM ls)",
    ],
    "SELECT site_id, i::BIGINT AS position, l[i + 1] AS sentence FROM (SELECT *, unnest(range(len(l))) AS i FROM lf)",
)
add(
    "every_shift_stats",
    [TRIPS, "shifted AS (SELECT *, CASE WHEN in_hour >= 6 AND in_hour < 14 THEN 'manana' WHEN in_hour >= 14 AND in_hour < 22 THEN 'tarde' ELSE 'noche' END AS shift FROM trips)", *stay_stats("shift", "stay", "shifted")],
    "SELECT s.shift, coalesce(n, 0) AS n, coalesce(over_count, 0) AS over_count, " + ", ".join(f"coalesce({r(c)}, 0) AS {c}" for c in STAY_COLUMNS) + " FROM (SELECT unnest(['manana', 'tarde', 'noche']) AS shift) s LEFT JOIN stay USING (shift)",
)

# --- routes --------------------------------------------------------------------------------------------------------

add("kpi5_destinations", [], SQL["kpi5_destinations_topn"].replace("rk <= 1", "rk <= 5"))
add("kpi5_multilevel_full", [], SQL["kpi5_multilevel"].replace("rk <= 2", "rk <= 7"))
add(
    "kpi5_reading",
    [
        *LU, "dc AS (SELECT site_id, coalesce(circuit_name, 'Sin clasificar') AS d FROM lu WHERE state = 'VALIDADO' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, coalesce(circuit_name, 'Sin clasificar')) = 1)",
        "ops AS (SELECT * FROM " + values_sql(dims.OPERATIONS, "operation, operation_name") + ")",
        "oc AS (SELECT site_id, operation_name FROM lu JOIN ops USING (operation) WHERE state <> 'ANOMALO' AND site_id NOT IN (SELECT site_id FROM dc) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, operation_name) = 1)",
    ],
    "SELECT site_id, 'destino_frecuente' AS kind, 'Destino más frecuente (completos): ' || d AS text FROM dc UNION ALL SELECT site_id, 'operacion_dominante', 'Operación dominante (válidos): ' || operation_name FROM oc",
)
_RANK = "CASE lower(product) " + " ".join(f"WHEN '{p.lower()}' THEN {i}" for i, p in enumerate(dims.PRODUCT_ORDER)) + " ELSE 50 END"
add("anomalous_products", LU, f"SELECT site_id, product, count(*) AS trips, row_number() OVER (PARTITION BY site_id ORDER BY {_RANK}, product) AS position FROM lu WHERE state = 'ANOMALO' GROUP BY site_id, product")
add("enriched_rows", LU, "SELECT trip_id, coalesce(circuit_code, circuit) AS catalog_code, coalesce(circuit_name, 'Sin catálogo') AS catalog_name, 'N/A' AS cir, 'N/A' AS vue, 'Sin descripción disponible' AS description FROM lu")
_USED = "(SELECT count(*) FROM lu WHERE lu.site_id = c.site_id AND circuit_code = code) AS trips"
add("circuit_search", LU, f"SELECT site_id, code, circuit_name, {_USED} FROM circuits c WHERE contains(upper(code), 'SILO') OR contains(upper(circuit_name), 'SILO')")
add("committee_circuits", LU, f"SELECT site_id, ordinal::BIGINT AS ordinal, code, {_USED} FROM circuits c WHERE ordinal < 12")

# --- dimensions and texts ------------------------------------------------------------------------------------------

add(
    "camera_catalog",
    [TRIPS, *READS, SITE],
    "SELECT 'CAM_S' || i || '_' || lpad((i + 1)::VARCHAR, 2, '0') AS camera_id, 'S' || i AS sector, 'Camara S' || i AS camera_name, CASE i WHEN 0 THEN 'INGRESO' WHEN 1 THEN 'EGRESO' WHEN 2 THEN 'CALADA' WHEN 4 THEN 'BALANZA' ELSE 'SECTOR_S' || i END AS role, i IN (0, 1, 2, 4) AS critical, site_id, (SELECT count(*) FROM reads WHERE reads.site_id = sites.site_id AND sector = 'S' || i) AS reads FROM sites, range(11) AS t(i)",
)
add("sector_names", [TRIPS, *INTERVALS, NAMES], "SELECT site_id, sector, count(*) AS segments, any_value(sector_name) AS sector_name FROM iv LEFT JOIN names USING (site_id, sector) GROUP BY ALL")
FULL_GATE = [
    *GATE,
    "fb AS (SELECT ge.*, tpl.k, (at_us - tpl.start) // 300000000 AS step FROM ge JOIN tpl ON ge.doc_number = 'D' || tpl.k)",
    f"""fu AS (SELECT site_id, visit_id, plate, doc_number, k, {case(EVENT_OF, 'letter')} AS event, at_us AS raw_us, NULL::VARCHAR AS result, k * 100 + step AS row_no FROM fb
  UNION ALL SELECT site_id, visit_id, plate, doc_number, k, 'LAB_RESULT_READY', at_us + 60000000, result, k * 100 + step + 30 FROM fb WHERE result IS NOT NULL
  UNION ALL SELECT site_id, visit_id, plate, doc_number, k, 'DISCHARGE_START', at_us - 120000000, NULL, k * 100 + step + 60 FROM fb WHERE letter = 'D')""",
    "fg AS (SELECT *, CASE WHEN k % 5 = 0 THEN raw_us // 3600000000 * 3600000000 ELSE raw_us END AS at_us FROM fu)",
    "fk AS (SELECT *, " + f"CASE WHEN visit_id IS NOT NULL THEN site_id || '|' || visit_id || '|' || {bucket(12)} ELSE site_id || '|' || plate || '|' || doc_number || '|' || {bucket(12)} END AS visit_key, "
    + "CASE event " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.STEP_ORDER.items()) + " ELSE 99 END AS o FROM fg)",
]
add("event_labels", FULL_GATE, f"SELECT event, count(*) AS events, any_value({case(dims.EVENT_LABELS, 'event')}) AS label FROM fg GROUP BY event")
add("visits_by_step", FULL_GATE, "SELECT visit_key, string_agg(event, ' ' ORDER BY at_us, o, row_no) AS events, min_by(plate, row_no) AS plate FROM fk GROUP BY 1")
_FIRST = {"ga": "GATE_CHECKIN", "lab": "LAB_RESULT_READY", "ds": "DISCHARGE_START", "de": "DISCHARGE_END", "ex": "EXIT", "so": "SCALE_OUT", "si": "SCALE_IN", "sm": "SAMPLE_SOLID_TAKEN"}
_MINUTES = "floor(({b} - {a}) / 60000000 + 0.5::DOUBLE)::BIGINT"
add(
    "visit_metrics_full",
    [*FULL_GATE, "fv AS (SELECT visit_key, min(at_us) AS z0, max(at_us) AS z1, bool_or(event = 'LAB_RESULT_READY' AND result = 'NO') AS rejected, " + ", ".join(f"min(at_us) FILTER (event = '{e}') AS {c}" for c, e in _FIRST.items()) + " FROM fk GROUP BY 1)"],
    f"""SELECT visit_key, CASE WHEN rejected AND ex IS NOT NULL AND de IS NULL THEN 'REJECTED' WHEN ex IS NOT NULL THEN 'CLOSED' ELSE 'OPEN' END AS visit_status,
  CASE WHEN ex IS NOT NULL THEN greatest(1, {_MINUTES.format(a='z0', b='z1')}) ELSE {_MINUTES.format(a='z0', b='z1')} END AS cycle_minutes, {_MINUTES.format(a='ga', b='sm')} AS to_sample_minutes, {_MINUTES.format(a='sm', b='lab')} AS lab_minutes, {_MINUTES.format(a='ds', b='de')} AS discharge_minutes,
  array_to_string(list_filter([CASE WHEN sm IS NULL AND de IS NOT NULL THEN 'SAMPLE_SOLID_TAKEN' END, CASE WHEN so IS NOT NULL AND si IS NULL THEN 'SCALE_IN' END], lambda m: m IS NOT NULL), ',') AS missing_steps FROM fv""",
)
add(
    "reconstructed_visits",
    [*VISITS, "ids AS (SELECT visit_key, min(visit_id) AS visit_id, count(*) AS ne2 FROM ky GROUP BY 1)"],
    f"""SELECT coalesce(ids.visit_id, visit_key) AS visit_id, site_id, plate, CASE WHEN status = 'INVALID' THEN 'REJECTED' ELSE 'CLOSED' END AS visit_status, 'UNKNOWN' AS cargo_form, a_us AS start_us, z_us AS end_us,
  CASE WHEN ne2 >= 2 THEN CASE WHEN exit_us IS NOT NULL THEN greatest(1, {_MINUTES.format(a='a_us', b='z_us')}) ELSE {_MINUTES.format(a='a_us', b='z_us')} END END AS cycle_minutes FROM vs JOIN ids USING (visit_key)""",
)
_NODE = {"GATE_CHECKIN": "A", "SCALE_IN": "B", "SAMPLE_SOLID_TAKEN": "C", "DISCHARGE_START": "D", "DISCHARGE_END": "D", "SCALE_OUT": "E", "EXIT": "F", "YARD_WAIT": "G"}
add(
    "sim_nodes_results",
    [
        *FULL_GATE, f"fo AS (SELECT *, {case(_NODE, 'event')} AS node, row_number() OVER (PARTITION BY visit_key ORDER BY at_us, o, row_no) - 1 AS event_no FROM fk)",
        "fn AS (SELECT visit_key, event_no, node, lag(node) OVER (PARTITION BY visit_key ORDER BY event_no) AS p FROM fo WHERE node IS NOT NULL)",
        "fx AS (SELECT visit_key, event_no, node, row_number() OVER (PARTITION BY visit_key ORDER BY event_no) - 1 AS ordinal FROM fn WHERE p IS DISTINCT FROM node)",
        "fl AS (SELECT l.visit_key, l.result, l.event_no, (SELECT max(ordinal) FROM fx WHERE fx.visit_key = l.visit_key AND fx.node = 'C' AND fx.event_no < l.event_no) AS ordinal FROM fo l WHERE event = 'LAB_RESULT_READY' AND result IS NOT NULL)",
        "fr AS (SELECT visit_key, ordinal, max_by(result, event_no) AS result FROM fl WHERE ordinal IS NOT NULL GROUP BY 1, 2)",
    ],
    "SELECT visit_key, ordinal, node, event_no, result FROM fx LEFT JOIN fr USING (visit_key, ordinal)",
)
add(
    "sim_nodes_located",
    [
        *FULL_GATE,
        "lo AS (SELECT *, row_no % 4 = 1 AND event IN ('SCALE_IN', 'YARD_WAIT', 'DISCHARGE_END', 'EXIT') AS odd FROM fk)",
        f"fo AS (SELECT *, {case(_NODE, 'event')} AS node, row_number() OVER (PARTITION BY visit_key ORDER BY at_us, CASE WHEN odd THEN 99 ELSE o END, row_no) - 1 AS event_no FROM lo)",
        "fn AS (SELECT visit_key, event_no, node, lag(node) OVER (PARTITION BY visit_key ORDER BY event_no) AS p FROM fo WHERE node IS NOT NULL)",
        "fx AS (SELECT visit_key, event_no, node, row_number() OVER (PARTITION BY visit_key ORDER BY event_no) - 1 AS ordinal FROM fn WHERE p IS DISTINCT FROM node)",
        "fl AS (SELECT l.visit_key, l.result, l.event_no, (SELECT max(ordinal) FROM fx WHERE fx.visit_key = l.visit_key AND fx.node = 'C' AND fx.event_no < l.event_no) AS ordinal FROM fo l WHERE event = 'LAB_RESULT_READY' AND result IS NOT NULL)",
        "fr AS (SELECT visit_key, ordinal, max_by(result, event_no) AS result FROM fl WHERE ordinal IS NOT NULL GROUP BY 1, 2)",
    ],
    "SELECT visit_key, ordinal, node, event_no, result FROM fx LEFT JOIN fr USING (visit_key, ordinal)",
)
add("normalised_events", FULL_GATE, "SELECT event, result, CASE WHEN row_no % 3 = 0 THEN 'SOLID' ELSE 'UNKNOWN' END AS cargo_form, count(*) AS events FROM fg GROUP BY ALL")
add(
    "truck_sector_codes",
    [TRIPS],
    "SELECT trip_id, CASE WHEN event_id % 3 = 0 THEN 'S' || event_id % 11 WHEN event_id % 3 = 1 THEN 'S' || event_id % 11 WHEN event_id % 4 = 2 THEN 'S4' ELSE 'S7' END AS sector_code FROM trips",
)
add(
    "tag_codes",
    [TRIPS],
    "SELECT trip_id, CASE WHEN event_id % 3 < 2 THEN 'MIX_' || event_id % 9 || '_V0' END AS mix, CASE WHEN event_id % 2 = 0 THEN event_id % 3 = 2 AND event_id % 9 = 5 ELSE event_id % 3 = 1 AND event_id % 9 = 4 END AS matches FROM trips",
)
add("deterministic_picks", [TRIPS], "SELECT trip_id, ['norte', 'sur', 'este'][(list_sum(list_transform(string_split(trip_id, ''), lambda c: ascii(c))) % 3 + 1)::INT] AS pick FROM trips")
add(
    "export_names",
    [TRIPS, "g AS (SELECT site_id, count(*) AS n, max(trip_date)::DATE::VARCHAR AS last FROM trips GROUP BY 1)"],
    "SELECT site_id, lower(regexp_replace('Estadía/' || site_id || ' (n=' || n || ')', '[^a-zA-Z0-9_-]', '_', 'g')) || '_20240130_1200.csv' AS file, concat_ws(' | ', 'Planta: ' || site_id, CASE WHEN n % 2 = 0 THEN 'Período: semana' END, 'Generado: ' || last) AS subtitle FROM g",
)

# --- state, fleet and history --------------------------------------------------------------------------------------

FLEET = [
    TRIPS, *STATE, CIRCUITS, "kinds AS (SELECT * FROM " + values_sql([(f"{k}-{s}", dims.OPERATION_TYPES[k]) for k, s in sorted({(c[4], c[5]) for c in dims.CIRCUITS})], "operation, operation_type") + ")",
    "cat AS (SELECT site_id, ordinal, code, equivalents, circuit_name, operation FROM circuits UNION ALL SELECT 'avellaneda', ordinal, code, equivalents, circuit_name, operation FROM circuits WHERE site_id = 'san_lorenzo')",
    "pk2 AS (SELECT trip_id, ts2.site_id, CASE WHEN len(visited) % 2 = 0 THEN 'X9' ELSE circuit END AS circuit, visited[-1] AS sector_code FROM ts2 JOIN (SELECT trip_id, circuit FROM trips) USING (trip_id) WHERE NOT complete AND visited[-1] NOT IN ('S3', 'S10'))",
    "fc AS (SELECT p.trip_id, min(ordinal) AS ordinal FROM pk2 p JOIN cat c ON c.site_id = p.site_id AND (code = circuit OR list_contains(equivalents, circuit)) GROUP BY 1)",
    "fleet AS (SELECT p.trip_id, p.site_id, c.code AS circuit_code, c.circuit_name, operation_type, sector_code FROM pk2 p LEFT JOIN fc USING (trip_id) JOIN cat c ON c.site_id = p.site_id AND c.ordinal = coalesce(fc.ordinal, 0) JOIN kinds USING (operation))",
]
add("fleet_trucks", FLEET, "SELECT * FROM fleet")
add("fleet_of_operation", FLEET, "SELECT trip_id, circuit_code FROM fleet WHERE operation_type = 'RECEPCION'")
_PANELS = "panels AS (SELECT * FROM " + values_sql(dims.FLEET_PANELS, "panel, label, op") + ")"
for _name, _of in (("fleet_panels", "true"), ("fleet_panels_of_operation", "operation_type = 'DESPACHANDO'")):
    add(
        _name,
        [*FLEET, SITE, _PANELS, f"ff AS (SELECT * FROM fleet WHERE {_of})", "n AS (SELECT s.site_id, panel, label, (SELECT count(*) FROM ff WHERE ff.site_id = s.site_id AND operation_type = op) AS trucks, (SELECT count(*) FROM ff WHERE ff.site_id = s.site_id) AS total FROM sites s, panels)"],
        "SELECT site_id, panel, label, trucks, CASE WHEN total > 0 THEN floor(trucks / total * 100 + 0.5::DOUBLE)::BIGINT ELSE 0 END AS pct FROM n",
    )
add(
    "paired_reads",
    [TRIPS, *READS, "l AS (SELECT trip_id, step, at_us, row_number() OVER (ORDER BY at_us, trip_id, step) AS position FROM reads)", "p AS (SELECT trip_id || '/' || step AS plan, sector AS planned, at_us AS planned_us FROM reads)"],
    "SELECT * FROM l JOIN (SELECT *, row_number() OVER (ORDER BY planned_us, plan) AS position FROM p) USING (position)",
)
add(
    "state_orders",
    [
        TRIPS, *STATE, f"al AS (SELECT *, row_number() OVER (ORDER BY s_us, trip_id, ordinal) AS n FROM (SELECT * FROM ({SQL['state_alerts']})) JOIN (SELECT trip_id, s_us FROM ts2) USING (trip_id))",
        "ai AS (SELECT trip_id, 'alt-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id FROM al)",
    ],
    """SELECT 'active' AS list, trip_id AS item, row_number() OVER (ORDER BY plate, trip_id) AS position FROM ts2 JOIN (SELECT trip_id, plate FROM trips) USING (trip_id) WHERE NOT complete
UNION ALL SELECT 'trips', trip_id, row_number() OVER (ORDER BY s_us, trip_id) FROM ts2 UNION ALL SELECT 'alerts', id, row_number() OVER (ORDER BY id) FROM ai""",
)
add(
    "alert_states",
    [
        ALERTS, "ch AS (SELECT alert_id, event_id, at_us, unnest(range(1, event_id % 5 + 1)) AS k FROM alerts)",
        f"cl AS (SELECT alert_id, ['ACKNOWLEDGED', 'RESOLVED', 'OPEN'][((event_id + k) % 3 + 1)::INT] AS status, at_us + CASE WHEN k = 4 THEN 1 ELSE k END * {HOUR_US} AS changed_us, k FROM ch)",
        "la AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY changed_us DESC, k DESC) = 1)",
    ],
    "SELECT a.alert_id, site_id, coalesce(la.status, a.status) AS status, coalesce(changed_us, at_us) AS updated_us FROM alerts a LEFT JOIN la USING (alert_id)",
)
add("zipped_reads", [TRIPS, *READS], "SELECT trip_id, step, camera_id, at_us, sector AS planned FROM reads")
add("alert_status_set", [ALERTS], "SELECT site_id, CASE WHEN alert_id = 'alert-9' THEN 'RESOLVED' ELSE status END AS status, count(*) AS alerts, max(alert_id) AS last FROM alerts GROUP BY 1, 2")
add("plants_union", [TRIPS], "SELECT site_id, trip_id, out_us FROM trips")
_WEEKLY = "isoyear(trip_date) || '-W' || lpad(weekofyear(trip_date)::VARCHAR, 2, '0')"
add("history_remaining", [TRIPS], f"SELECT trip_id, site_id, out_us FROM trips WHERE {_WEEKLY} >= '2024-W03'")
add("history_weeks", [TRIPS], f"SELECT site_id, 'historico_semana_' || {_WEEKLY} AS archive, count(*) AS trips FROM trips WHERE {_WEEKLY} < '2024-W03' GROUP BY ALL")
add("history_months", [TRIPS], "SELECT site_id, 'historico_' || strftime(trip_date, '%Y_%m') AS archive, count(*) AS trips FROM trips WHERE strftime(trip_date, '%Y-%m') < '2024-02' GROUP BY ALL")
add("history_over_cap", [TRIPS], "SELECT trip_id, site_id, circuit, trip_date::DATE::VARCHAR AS trip_date, state AS classification FROM trips QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY out_us DESC, trip_id DESC) > 100")
add("history_within_cap", [TRIPS], "SELECT trip_id, site_id, out_us FROM trips QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY out_us DESC, trip_id DESC) <= 75000")

_MONTH_END, _WEEK_END = "last_day(trip_date::DATE)", "(trip_date::DATE + (7 - isodow(trip_date))::INT)"
add(
    "history_rolled",
    [TRIPS, f"pl AS (SELECT site_id, out_us, CASE WHEN least({_MONTH_END}, {_WEEK_END}) >= DATE '1970-01-01' + {NOW_US // DAY_US} THEN 'live' WHEN {_MONTH_END} < {_WEEK_END} THEN 'historico_' || strftime(trip_date, '%Y_%m') ELSE 'historico_semana_' || {_WEEKLY} END AS archive FROM trips)"],
    "SELECT site_id, archive, count(*) AS trips, max(out_us) AS last_us FROM pl GROUP BY ALL",
)
_REF = f"DATE '1970-01-01' + ref_day::INT"
_SPANS = {
    "day": ("r", "r"), "week": ("r - 6", "r"), "month": ("date_trunc('month', r)::DATE", "last_day(r)"), "last_month": ("r - 30", "r"), "week-day": ("r - 2", "r - 2"), "month-week": ("last_day(r) - 13", "last_day(r) - 7"),
    "month-week-day": ("last_day(r) - 8", "last_day(r) - 8"),
}
add(
    "periods_by_day",
    [TRIPS, SITE, REFS, f"rd AS (SELECT site_id, {_REF} AS r FROM refs)"],
    " UNION ALL ".join(f"SELECT '{n}' AS period, t.site_id, count(*) AS trips, max(out_us) AS last_us, {r('avg(stay)')} AS mean_stay FROM trips t JOIN rd USING (site_id) WHERE trip_date::DATE BETWEEN {a} AND {b} GROUP BY 2" for n, (a, b) in _SPANS.items()),
)
add("overlapping_by_day", [TRIPS], SQL["overlapping_trips"].rsplit("\n", 1)[1])

# --- sources -------------------------------------------------------------------------------------------------------

_PLANT = "list_position(['ricardone', 'san_lorenzo', 'avellaneda'], site_id)"


def _place(at: str, *more: str) -> str:
    """A row's number in the whole input: plants in order, their days in order, events in order."""
    return f"(row_number() OVER (ORDER BY {', '.join([_PLANT, f'{at} // {DAY_US}', 'event_id // 4096', 'event_id', *more])}) - 1)"


add(
    "envelope_trips",
    [TRIPS, f"tn AS (SELECT *, {_place('in_us')} AS i FROM trips)"],
    """SELECT CASE WHEN event_id % 5 <> 1 THEN trip_id ELSE 'trip-' || i END AS trip_id, CASE WHEN event_id % 7 <> 2 THEN 'T' || truck_id ELSE 'truck-' || i END AS truck_id, CASE WHEN event_id % 11 <> 3 THEN plate ELSE 'N/A' END AS plate, site_id,
  CASE WHEN event_id % 6 <> 0 THEN circuit ELSE 'N/A' END AS circuit, in_us, out_us, floor(duration_minutes)::DOUBLE AS duration_minutes,
  CASE WHEN event_id % 3 = 0 THEN state WHEN event_id % 2 = 0 THEN 'VALIDADO' ELSE 'CON_OBSERVACIONES' END AS state, CASE WHEN event_id % 13 = 0 THEN '2024-01-05' ELSE trip_date::DATE::VARCHAR END AS trip_date FROM tn""",
)
add(
    "envelope_alerts",
    [ALERTS, f"an AS (SELECT *, {_place('at_us')} AS i FROM alerts)"],
    f"""SELECT CASE WHEN event_id % 5 <> 1 THEN alert_id ELSE 'alert-' || i END AS alert_id, CASE WHEN event_id % 10 <> 4 THEN alert_type ELSE 'SIN_ACTUALIZACION' END AS alert_type, CASE WHEN event_id % 8 <> 0 THEN severity ELSE 'LOW' END AS severity, status, site_id,
  CASE WHEN event_id % 3 = 0 THEN 'T' || truck_id ELSE 'truck-' || i END AS truck_id, 'N/A' AS plate, CASE WHEN event_id % 2 = 0 THEN coalesce(sector, 'S9') ELSE 'S9' END AS sector, 'S7' AS expected, 'S9' AS observed, at_us, greatest(0, floor(({NOW_US} - at_us) / 60000000))::BIGINT AS elapsed_minutes FROM an""",
)
add(
    "envelope_events",
    [TRIPS, *READS, f"rn AS (SELECT *, {_place('at_us', 'step')} AS i FROM (SELECT *, trip_id[6:]::BIGINT AS event_id FROM reads))"],
    """SELECT CASE WHEN step <> 3 THEN trip_id || '/' || step ELSE 'enr-' || i END AS event_id, at_us, CASE WHEN step <> 1 THEN camera_id ELSE 'CAM_UNKNOWN' END AS camera_id, sector, CASE WHEN step <> 4 THEN trip_id ELSE 'truck-' || i END AS truck_id,
  CASE WHEN step <> 2 THEN plate ELSE 'N/A' END AS plate, site_id, circuit FROM rn""",
)
add("envelope_raw_events", [TRIPS, *READS], "SELECT CASE WHEN step <> 2 THEN plate END AS \"plateNo\", 'anpr' AS \"eventType\", count(*) AS reads FROM reads GROUP BY ALL")
add("envelope_generated", [TRIPS], f"SELECT 'at ' || arg_max(in_us // {DAY_US}, {_PLANT} * 1000000 + in_us // {DAY_US}) AS generated_at FROM trips WHERE (in_us // {DAY_US}) % 2 = 0")
add(
    "csv_event_rows",
    [*GATE, "gx AS (SELECT ge.*, tpl.k * 100 + (at_us - tpl.start) // 300000000 AS row_no FROM ge JOIN tpl ON ge.doc_number = 'D' || tpl.k)"],
    f"SELECT site_id, visit_id, plate, {case(EVENT_OF, 'letter')} AS event_type, CASE WHEN row_no % 2 = 0 THEN 12.5::DOUBLE END AS weight_kg, result AS lab_result, at_us FROM gx WHERE row_no % 13 <> 0",
)
add(
    "csv_lines",
    [TRIPS, "g AS (SELECT site_id, circuit, count(*) AS n FROM trips GROUP BY ALL)"],
    '''SELECT 0::BIGINT AS part, '# Recorridos' AS line UNION ALL SELECT 0, '# Planta: todas' UNION ALL SELECT 1, 'name,trips'
UNION ALL SELECT 2, '"' || site_id || ', ""' || circuit || '""",' || CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE '' END FROM g''',
)
