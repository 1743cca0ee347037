"""Views into saturation and periods: reference days, the series around an episode, markers by bucket, orderings, readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.scalar import DAY_US, HOUR_US, alert_category, day_number, day_range, hour_of, sector_order
from siloway.operators.positions import positioned
from siloway.operators.saturation import executive, occupancy

#: The reference instant of a site without trips, 2026-03-31 12:00 UTC (fixed value).
DEFAULT_REFERENCE_US = 1_774_958_400_000_000

#: Categories of alerts that a reading names, in this order, and lines of a reading (fixed values).
TOLD_CATEGORIES, MOST_LINES = ["Espera", "Recalado", "Desvío operativo", "Doble paso"], 5


def reference_days(trips: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, max_out_us, ref_day): the last exit of each site and its day; a site without trips gets the default."""
    last = trips.groupBy("site_id").agg(F.max("out_us").alias("max_out_us"))
    found = sites.select("site_id").join(last, "site_id", "left").fillna(DEFAULT_REFERENCE_US, ["max_out_us"])
    return found.withColumn("ref_day", day_number(F.col("max_out_us")))


def reference_ranges(references: DataFrame) -> DataFrame:
    """(site_id, period, start_us, end_us): the whole days of the periods up to each site's reference day."""
    made = []
    for name in ("last_day", "last_week", "last_month"):
        start, end = day_range(F.col("ref_day"), name)
        made.append(F.struct(F.lit(name).alias("period"), start.alias("start_us"), end.alias("end_us")))
    return references.select("site_id", F.explode(F.array(*made)).alias("r")).select("site_id", "r.*")


def longest_episodes(found: DataFrame, by: list[str]) -> DataFrame:
    """The longest episode of each group, the first of equals: a row per group, so small enough to be broadcast."""
    rank = F.struct(F.col("minutes"), -F.col("start_us"), -sector_order(F.col("sector")))
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("e")).select(*by, "e.*")


def detail_series(selected: DataFrame, intervals: DataFrame, trips: DataFrame, step_us: int) -> DataFrame:
    """(site_id, sector, bucket, start_us, end_us, occupancy, capacity, arrivals, departures, net, cumulative) of episode windows.

    ``selected`` has one episode per site and sector with its window (``saturation.detail_window``), so it is broadcast; facts
    are reduced to the windows and placed in buckets by arithmetic.
    """
    by = ["site_id", "sector"]
    window = F.broadcast(selected.select(*by, "window_start", "window_end", "capacity"))
    last = F.expr(f"(window_end - window_start - 1) div {step_us}")
    spine = window.select(*by, "window_start", "window_end", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bucket"))
    left = F.col("window_start") + F.col("bucket") * step_us
    inside = intervals.select(*by, "start_us", "end_us").join(window, by).filter("start_us < window_end and end_us > window_start")
    inside = inside.withColumn("start_us", F.greatest("start_us", "window_start")).withColumn("end_us", F.least("end_us", "window_end"))
    touched = inside.withColumn("bucket", F.explode(F.expr(f"sequence((start_us - window_start) div {step_us}, (end_us - 1 - window_start) div {step_us})")))
    cut = touched.select(*by, "bucket", F.greatest("start_us", left).alias("start_us"), F.least("end_us", left + step_us).alias("end_us"))
    busy = occupancy(cut, [*by, "bucket"], chunk_us=1 << 60).groupBy(*by, "bucket").agg(F.max("occupied").alias("occupancy"))

    moves = trips.select("site_id", F.explode(F.array(F.struct(F.col("in_us").alias("at_us"), F.lit(1).alias("come")), F.struct(F.col("out_us").alias("at_us"), F.lit(0).alias("come")))).alias("m"))
    moves = moves.select("site_id", "m.*").join(window, "site_id").filter("at_us >= window_start and at_us < window_end")
    flow = moves.groupBy(*by, F.expr(f"(at_us - window_start) div {step_us}").alias("bucket")).agg(F.sum("come").alias("arrivals"), F.sum(1 - F.col("come")).alias("departures"))
    full = spine.join(busy, [*by, "bucket"], "left").join(flow, [*by, "bucket"], "left").fillna(0, ["occupancy", "arrivals", "departures"])
    full = full.withColumn("net", F.col("arrivals") - F.col("departures"))
    running = F.sum("net").over(Window.partitionBy(*by).orderBy("bucket"))
    return full.select(*by, "bucket", left.alias("start_us"), F.least("window_end", left + step_us).alias("end_us"), "occupancy", "capacity", "arrivals", "departures", "net", running.alias("cumulative"))


def marker_buckets(selected: DataFrame, alerts: DataFrame, step_us: int) -> DataFrame:
    """(site_id, sector, bucket, markers): buckets of the episode windows that hold alerts of the sector or of none."""
    window = F.broadcast(selected.select("site_id", F.col("sector").alias("of"), "window_start", "window_end"))
    rows = alerts.join(window, "site_id").filter("at_us >= window_start and at_us < window_end and (sector is null or sector = of)")
    return rows.groupBy("site_id", F.col("of").alias("sector"), F.expr(f"(at_us - window_start) div {step_us}").alias("bucket")).agg(F.count(F.lit(1)).alias("markers"))


def with_day_flag(buckets: DataFrame) -> DataFrame:
    """Buckets (``flow.time_buckets``) with ``new_day``, whether a bucket is the first of its day. They are few."""
    day = day_number(F.col("start_us"))
    return buckets.withColumn("new_day", ~F.coalesce(F.lag(day).over(Window.orderBy("bucket")) == day, F.lit(False)))


#: Keys that a sector table can be sorted by.
TABLE_KEYS = ("sector", "nombre", "capacity", "critical", "excess", "status")


def sorted_table(summary: DataFrame, names: DataFrame, capacity: DataFrame, key: str = "sector", descending: bool = False) -> DataFrame:
    """Sector summaries with names, capacities and ``position`` in their site by a key; equal ones by sector number.

    A site has a few dozen sectors, so a window by site is small at any amount of trips.
    """
    rows = summary.join(F.broadcast(names), ["site_id", "sector"], "left").join(F.broadcast(capacity), ["site_id", "sector"], "left")
    column = {
        "sector": sector_order(F.col("sector")), "nombre": F.coalesce("sector_name", "sector"), "capacity": F.coalesce("capacity", F.lit(-1)),
        "critical": F.col("critical_hour"), "excess": F.col("max_excess"), "status": F.col("status"),
    }[key]
    order = [column.desc() if descending else column.asc(), sector_order(F.col("sector")), F.col("sector")]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)))


def ranked_summaries(summary: DataFrame) -> DataFrame:
    """Summaries with ``position``: minutes over capacity (to a millionth), then episodes, then excess, most first."""
    order = [F.round("saturated_minutes", 6).desc(), F.desc("episodes"), F.desc("max_excess"), sector_order(F.col("sector"))]
    return summary.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)))


def timeline_rows(summary: DataFrame, by_count: bool = True) -> DataFrame:
    """Summaries with ``position`` in an episode timeline: by episodes and then minutes, or by sector number."""
    order = [F.desc("episodes"), F.desc("saturated_minutes"), sector_order(F.col("sector"))] if by_count else [sector_order(F.col("sector")), F.col("sector")]
    return summary.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)))


def first_sectors(density: DataFrame, n: int) -> DataFrame:
    """The first n sectors of each site by number: the length of a report's list."""
    order = Window.partitionBy("site_id").orderBy(sector_order(F.col("sector")), "sector")
    return density.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def _line(df: DataFrame, rule: int, sentence: Column) -> DataFrame:
    return df.select("site_id", F.lit(rule).alias("rule"), sentence.alias("sentence"))


def reading(summary: DataFrame, found: DataFrame, overlaps: DataFrame, alerts: DataFrame, series: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, position, sentence): all that a report says of a site's saturation, five lines at most; of a site of ``sites`` of
    which there is nothing to say, that.

    ``overlaps`` is ``saturation.simultaneous``, ``alerts`` those in range, ``series`` the detail series of the site's longest
    episode with its bounds (episode_start, episode_end).
    """
    top = executive(summary)
    best = summary.join(top.select("site_id", F.col("top_sector").alias("sector")), ["site_id", "sector"])
    worst = _line(best, 1, F.format_string("%s fue el sector más comprometido: %d episodio(s) y %.1f h con ocupación por encima de la capacidad.", "sector", "episodes", F.col("saturated_minutes") / 60))
    none = _line(top.filter("top_sector is null"), 1, F.lit("No se detectaron episodios de saturación (ocupación simultánea por encima de capacidad) en el período analizado."))
    hours = found.groupBy("site_id", hour_of(F.col("start_us")).alias("hour")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    hours = hours.groupBy("site_id").agg(F.max_by("hour", F.struct(F.col("us"), -F.col("hour"))).alias("hour"))
    when = _line(hours, 2, F.format_string("La mayor concentración de minutos saturados se observa alrededor de las %02d:00 (según inicio de episodios).", "hour"))
    rising = series.filter("net > 0 and start_us >= episode_start and start_us < episode_end").groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    rises = _line(rising, 3, F.lit("En el episodio seleccionado, en varias franjas consecutivas los ingresos superan a los egresos; se observa junto con el tramo saturado."))
    kinds = alerts.select("site_id", alert_category(F.col("alert_type")).alias("kind")).distinct().groupBy("site_id").agg(F.collect_set("kind").alias("kinds"))
    told = F.filter(F.array(*[F.lit(c) for c in TOLD_CATEGORIES]), lambda c: F.array_contains("kinds", c))
    kinds = kinds.withColumn("told", told).filter("size(told) > 0").join(found.select("site_id").distinct(), "site_id", "left_semi")
    alerted = _line(kinds, 4, F.concat(F.lit("En el período analizado coinciden alertas de tipo: "), F.array_join("told", ", "), F.lit("; no implica causalidad directa con la saturación.")))
    pair = overlaps.groupBy("site_id").agg(F.max_by(F.struct("sector_a", "sector_b"), F.struct("overlap_count", "sector_a", "sector_b")).alias("p"))
    both = _line(pair, 5, F.format_string("Se observa solapamiento temporal de episodios de saturación entre %s y %s.", "p.sector_a", "p.sector_b"))
    lines = worst
    for part in (none, when, rises, alerted, both):
        lines = lines.unionByName(part)
    if sites is not None:
        rest = sites.select("site_id").join(lines.select("site_id"), "site_id", "left_anti")
        lines = lines.unionByName(_line(rest, 6, F.lit("No hay datos suficientes para generar lectura automática en este período.")))
    lines = lines.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy("rule"))).filter(F.col("position") <= MOST_LINES)
    return lines.select("site_id", "position", "sentence")


def newest_first(rows: DataFrame, at: str = "out_us", tie: str = "trip_id") -> DataFrame:
    """Rows with ``position``, from 1, in their site's list by time, newest first. Hours are counted and only an hour's rows are
    ranked, so no site's history is sorted in one task."""
    return positioned(rows, ["site_id"], -F.floor(F.col(at) / HOUR_US), [F.desc(at), F.col(tie)])


def first_circuits(circuits: DataFrame, n: int = 12) -> DataFrame:
    """The first n circuits of each site in the catalog's order: the length of a report's list."""
    return circuits.filter(F.col("ordinal") < n)


def page_durations(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, std, median, mode) of stays in hours; the mode is the middle of the fullest tenth of an hour.

    The median comes from counts of distinct values in ``stats.ranked_quantiles``.
    """
    from siloway.operators import stats

    hours = points.withColumn("hours", F.col("stay") / 60)
    base = hours.groupBy(*by).agg(F.count("hours").alias("n"), F.avg("hours").alias("mean"), stats.std("hours").alias("std"))
    start = F.floor(F.floor(F.col("hours") / 0.1) * 0.1 * 10 + 0.5) / 10
    bins = hours.groupBy(*by, start.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    mode = bins.groupBy(*by).agg((F.max_by("bin", F.struct(F.col("c"), -F.col("bin"))) + 0.05).alias("mode"))
    return base.join(stats.ranked_quantiles(hours, by, "hours", {"median": 0.5}), by).join(mode, by)


def of_bar(points: DataFrame, codes: list[str] | None, state: str | None) -> DataFrame:
    """Points of a state whose circuit is one of a bar's codes or shares a base code with one."""
    from siloway.functions.scalar import base_code

    rows = points if state is None else points.filter(F.col("state") == state)
    if codes is None:
        return rows
    bases = [base_code(F.lit(c)) for c in codes]
    return rows.filter(F.col("circuit").isin(codes) | base_code(F.col("circuit")).isin(*bases))
