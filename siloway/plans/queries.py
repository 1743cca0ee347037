"""Every operator applied to the test tables: name -> (spark, folder) -> DataFrame.

Integers come out as BIGINT, doubles rounded to six places (to nine first, which takes away what the order of a sum
leaves), dates as text: the forms that other engines give too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.functions import dims, scalar
from siloway.functions.scalar import DAY_US, HOUR_US
from siloway.operators import flow, pages, routes, saturation, state, stats, visits
from siloway.sources import adapters

#: The reference day (2024-01-30) and the week and month up to its end.
REF_DAY = 19752
NOW_US = (REF_DAY + 1) * DAY_US
WEEK_US, MONTH_US = NOW_US - 7 * DAY_US, NOW_US - 30 * DAY_US
SITES = ["ricardone", "san_lorenzo", "avellaneda"]
#: Capacities over this give sectors that the full ones leave unsaturated.
DIVISOR = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    forms = {"int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "double": lambda c: F.round(F.round(c, 9), 6) + 0.0, "date": lambda c: c.cast("string")}
    return df.select(*[(forms[t](F.col(c)) if t in forms else F.col(c)).alias(c) for c, t in df.dtypes])


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


# --- statistics ----------------------------------------------------------------------------------------------------


@query
def stay_time_stats(spark, d):
    return stats.stay_time_stats(adapters.trips(spark, d), ["site_id"], "stay", "event_id")


@query
def variability_stats(spark, d):
    return stats.variability(adapters.trips(spark, d), ["site_id"], "stay")


@query
def mode_first_seen(spark, d):
    return stats.mode(adapters.trips(spark, d).withColumn("whole", F.floor("duration_minutes")), ["site_id", "circuit"], "whole", "event_id")


@query
def percentiles(spark, d):
    return stats.ranked_quantiles(adapters.trips(spark, d), ["circuit"], "duration_minutes", {f"p{p}": p / 100 for p in (5, 25, 50, 75, 90, 95)})


@query
def outliers_iqr(spark, d):
    return stats.outliers_iqr(adapters.trips(spark, d), ["site_id"], "duration_minutes").select("trip_id", "site_id", "duration_minutes")


@query
def outliers_zscore(spark, d):
    return stats.outliers_z(adapters.trips(spark, d), ["site_id"], "duration_minutes").select("trip_id", "site_id", "z")


@query
def zscore_class(spark, d):
    z = stats.z_scored(adapters.trips(spark, d), ["site_id"], "duration_minutes")
    return z.groupBy("site_id", scalar.outlier_class(F.col("z")).alias("kind")).agg(F.count(F.lit(1)).alias("trips"), F.max("z").alias("max_z"))


@query
def gaussian_curve(spark, d):
    return stats.gaussian_curve(adapters.trips(spark, d), "stay", 100.0)


@query
def kde_curve(spark, d):
    hours = adapters.trips(spark, d).withColumn("hours", F.floor("stay") / 60)
    return stats.kde_curve(hours, "hours")


@query
def histogram_smoothed(spark, d):
    return stats.histogram_smoothed(adapters.trips(spark, d).withColumn("hours", F.col("stay") / 60), "hours")


@query
def histogram_sparse(spark, d):
    return stats.histogram_sparse(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0)


@query
def binned_mode(spark, d):
    return stats.binned_mode(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0)


@query
def shape_indicators(spark, d):
    return stats.shape_indicators(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0)


@query
def radar_scores(spark, d):
    hours = adapters.trips(spark, d).withColumn("hours", F.col("stay") / 10)
    s = stats.stay_time_stats(hours, ["site_id"], "hours", "event_id")
    return stats.radar(s.withColumnRenamed("mode", "moda").withColumnRenamed("median", "mediana"), ["site_id"])


@query
def shape_radar_scores(spark, d):
    s = stats.shape_indicators(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0)
    return stats.radar_total(stats.radar(s, ["site_id"], shape=True), ["site_id"])


# --- flow ----------------------------------------------------------------------------------------------------------


@query
def hourly_flow(spark, d):
    return flow.hourly_flow(adapters.trips(spark, d), dims.sites(spark))


@query
def hourly_flow_week(spark, d):
    return flow.hourly_flow_week(adapters.trips(spark, d), dims.sites(spark), REF_DAY)


@query
def flow_saturation_metrics(spark, d):
    week = flow.hourly_flow_week(adapters.trips(spark, d), dims.sites(spark), REF_DAY)
    return flow.flow_saturation(week, saturation=12, alert=8)


@query
def threshold_crossings(spark, d):
    return flow.crossings(flow.hourly_flow_week(adapters.trips(spark, d), dims.sites(spark), REF_DAY), 10)


@query
def ingress_kpis(spark, d):
    return flow.ingress_kpis(flow.hourly_flow_week(adapters.trips(spark, d), dims.sites(spark), REF_DAY), REF_DAY)


@query
def avg_duration_by_hour(spark, d):
    return flow.stay_by_hour(adapters.trips(spark, d), dims.sites(spark))


@query
def daily_stay_mean(spark, d):
    return flow.daily_mean(adapters.trips(spark, d))


@query
def stats_by_shift(spark, d):
    return stats.stay_time_stats(flow.by_shift(adapters.trips(spark, d)), ["shift"], "stay", "event_id")


@query
def duration_scatter(spark, d):
    return flow.duration_points(adapters.trips(spark, d))


@query
def bucket_flow_series(spark, d):
    return flow.flow_by_bucket(adapters.trips(spark, d), WEEK_US, NOW_US)


@query
def time_buckets(spark, d):
    end = NOW_US - 20 * 60_000_000
    return flow.with_arrivals(flow.time_buckets(spark, WEEK_US, end, HOUR_US // 2), adapters.trips(spark, d), WEEK_US, end, HOUR_US // 2)


@query
def deterministic_deviates(spark, d):
    n = F.col("event_id")
    return adapters.trips(spark, d).select("trip_id", scalar.seeded_random(n).alias("uniform"), scalar.normal_deviate((n % 97 + 1) / 98, (n % 89) / 89).alias("normal"))


# --- density and saturation ----------------------------------------------------------------------------------------


@query
def sector_intervals(spark, d):
    return saturation.sector_intervals(adapters.trips(spark, d))


@query
def sector_density(spark, d):
    trips = adapters.trips(spark, d)
    return saturation.sector_density(trips, adapters.alerts(spark, d), dims.capacity(spark))


def _week_intervals(spark, d):
    return saturation.clipped(saturation.sector_intervals(pages.overlapping(adapters.trips(spark, d), WEEK_US, NOW_US)), WEEK_US, NOW_US)


def _episodes(spark, d):
    return saturation.episodes(_week_intervals(spark, d), dims.capacity(spark, DIVISOR))


def _heatmap(spark, d):
    return saturation.heatmap(_week_intervals(spark, d), dims.capacity(spark, DIVISOR), WEEK_US, NOW_US, HOUR_US)


def _summaries(spark, d):
    return saturation.summaries(_episodes(spark, d), _heatmap(spark, d), HOUR_US)


@query
def saturation_episodes(spark, d):
    return _episodes(spark, d)


@query
def saturation_episodes_full_capacity(spark, d):
    return saturation.episodes(saturation.sector_intervals(adapters.trips(spark, d)), dims.capacity(spark))


@query
def saturation_heatmap(spark, d):
    return saturation.heatmap(_week_intervals(spark, d), dims.capacity(spark, DIVISOR), WEEK_US, NOW_US, HOUR_US)


@query
def sector_summaries(spark, d):
    return _summaries(spark, d)


@query
def saturation_executive(spark, d):
    return saturation.executive(_summaries(spark, d))


@query
def simultaneous_episodes(spark, d):
    return saturation.simultaneous(_episodes(spark, d))


@query
def detail_window(spark, d):
    return saturation.detail_window(_episodes(spark, d), HOUR_US, WEEK_US, NOW_US).select("site_id", "sector", "start_us", "window_start", "window_end")


@query
def operational_markers(spark, d):
    return saturation.markers(adapters.alerts(spark, d), WEEK_US, NOW_US, "S4")


@query
def alert_category(spark, d):
    return adapters.alerts(spark, d).groupBy(scalar.alert_category(F.col("alert_type")).alias("category")).agg(F.count(F.lit(1)).alias("alerts"))


@query
def saturation_narrative(spark, d):
    return saturation.narrative(_summaries(spark, d), _episodes(spark, d), saturation.simultaneous(_episodes(spark, d)))


# --- routes --------------------------------------------------------------------------------------------------------


def _looked_up(spark, d):
    return routes.with_product(routes.circuit_lookup(adapters.trips(spark, d), dims.circuits(spark)))


@query
def circuit_lookup(spark, d):
    return _looked_up(spark, d).select("trip_id", "site_id", "circuit", "circuit_code", "circuit_name", "operation")


@query
def classify_by_sequence(spark, d):
    return routes.classify_by_sequence(adapters.trips(spark, d), dims.circuits(spark)).groupBy("site_id", "circuit", "sequence_code").agg(F.count(F.lit(1)).alias("trips"))


@query
def kpi5_classification(spark, d):
    return routes.states(adapters.trips(spark, d), ["site_id"])


@query
def kpi5_operations(spark, d):
    return routes.operations(_looked_up(spark, d), dims.operations(spark))


@query
def kpi5_destinations_topn(spark, d):
    return routes.destinations(_looked_up(spark, d), top=1)


@query
def kpi5_security(spark, d):
    return routes.security(routes.of_product(_looked_up(spark, d), "Soja"), ["site_id"])


@query
def kpi5_multilevel(spark, d):
    return routes.multilevel(_looked_up(spark, d), top=2)


@query
def product_labels(spark, d):
    return _looked_up(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("trips"))


@query
def product_options(spark, d):
    return routes.product_options(_looked_up(spark, d))


@query
def duration_by_plant_circuit(spark, d):
    return routes.duration_by_circuit(adapters.trips(spark, d))


@query
def historical_valid_bars(spark, d):
    return routes.valid_bars(_looked_up(spark, d))


# --- visits --------------------------------------------------------------------------------------------------------


def _trips_of(spark, d):
    return visits.trips_of(adapters.gate_events(spark, d))


@query
def visit_keys(spark, d):
    return visits.with_visit_key(adapters.gate_events(spark, d)).groupBy("visit_key", "key_fallback").agg(F.count(F.lit(1)).alias("events"))


@query
def visit_paths(spark, d):
    return visits.with_path(visits.visits(adapters.gate_events(spark, d))).select("visit_key", "path", "last_result")


@query
def trip_validation(spark, d):
    return _trips_of(spark, d).select("visit_key", "site_id", "plate", "path", "path_display", "status", F.array_join("flags", ",").alias("flags"))


@query
def trip_flags(spark, d):
    return _trips_of(spark, d).select(F.explode("flags").alias("flag"), "status").groupBy("flag", "status").agg(F.count(F.lit(1)).alias("visits"))


@query
def trip_story(spark, d):
    return visits.with_story(_trips_of(spark, d)).select("visit_key", "story", "explanation")


@query
def visit_status_metrics(spark, d):
    return visits.with_metrics(visits.visits(adapters.gate_events(spark, d), 12)).select(
        "visit_key", "visit_status", "cycle_minutes", "to_sample_minutes", "yard_minutes", F.array_join("missing_steps", ",").alias("missing_steps")
    )


@query
def visit_scatter(spark, d):
    return visits.scatter(_trips_of(spark, d))


@query
def visit_scatter_stats(spark, d):
    return visits.scatter_stats(visits.scatter(_trips_of(spark, d)))


@query
def visit_pie(spark, d):
    return visits.pie(_trips_of(spark, d))


@query
def visit_paths_bar(spark, d):
    return visits.path_bars(_trips_of(spark, d))


@query
def visits_by_bucket(spark, d):
    return visits.of_bucket(_trips_of(spark, d), "PERFECT").select("visit_key", "status")


@query
def sim_nodes(spark, d):
    return visits.sim_nodes(visits.visits(adapters.gate_events(spark, d)))


# --- state and pages -----------------------------------------------------------------------------------------------


def _reads(spark, d):
    return adapters.camera_events(adapters.trips(spark, d))


def _truck_trips(spark, d):
    expected = state.expected_of({adapters.CIRCUIT_OF[k]: v for k, v in adapters.SECTORS_OF.items()}, SITES, spark)
    return state.truck_trips(_reads(spark, d), expected)


@query
def truck_state(spark, d):
    return _truck_trips(spark, d).select("trip_id", "site_id", "complete", "classification", "minutes", "current_sector", F.array_join("visited", " ").alias("visited"))


@query
def state_alerts(spark, d):
    return state.state_alerts(_truck_trips(spark, d), NOW_US).select("trip_id", "ordinal", "alert_type", "severity", "message")


@query
def trucks_in_plant(spark, d):
    return state.in_plant(state.active(_truck_trips(spark, d)), _reads(spark, d), NOW_US - 12 * HOUR_US).select("trip_id", "site_id", "current_sector", "reads", "first_us", "last_us", "last_camera")


@query
def enrich_camera_events(spark, d):
    reads = _reads(spark, d).select("trip_id", "plate", "camera_id", "at_us", "step")
    cameras = spark.createDataFrame([(f"CAM_S{i}", f"S{i}") for i in range(11)], "camera_id string, sector string")
    trucks = adapters.trips(spark, d).select("plate", "truck_id").distinct()
    return state.enrich(reads, cameras, trucks).select("trip_id", "step", "camera_id", "sector", "truck_id", "at_us")


@query
def home_summary(spark, d):
    return pages.home_summary(state.active(_truck_trips(spark, d)), adapters.alerts(spark, d), adapters.trips(spark, d), dims.sites(spark), REF_DAY)


@query
def home_activity_day(spark, d):
    return pages.home_activity(adapters.trips(spark, d), "day", REF_DAY, SITES)


@query
def home_activity_week(spark, d):
    return pages.home_activity(adapters.trips(spark, d), "week", REF_DAY, SITES)


@query
def home_activity_month(spark, d):
    return pages.home_activity(adapters.trips(spark, d), "month", REF_DAY, SITES)


@query
def home_classification(spark, d):
    return pages.home_classification(adapters.trips(spark, d), REF_DAY)


@query
def home_alerts(spark, d):
    return pages.home_alerts(adapters.alerts(spark, d), NOW_US)


def _peaks(spark, d):
    return saturation.peak_concurrent(saturation.sector_intervals(adapters.trips(spark, d)), ["site_id", "sector"])


@query
def committee_insights(spark, d):
    return pages.committee(adapters.trips(spark, d), adapters.alerts(spark, d), _peaks(spark, d), dims.sites(spark))


@query
def plant_comparison(spark, d):
    return pages.plant_comparison(adapters.trips(spark, d), adapters.alerts(spark, d), _peaks(spark, d), dims.sites(spark))


@query
def plant_flow(spark, d):
    return pages.plant_flow(adapters.trips(spark, d), dims.sites(spark))


@query
def alerts_filtered(spark, d):
    return pages.filtered_alerts(adapters.alerts(spark, d), site="san_lorenzo", resolved=False, severity="HIGH").select("alert_id", "status", "sector")


@query
def alert_counts(spark, d):
    return pages.alert_counts(adapters.alerts(spark, d))


@query
def alert_deviations(spark, d):
    return pages.deviations(adapters.alerts(spark, d)).select("alert_id", "alert_type").unionByName(pages.deviations(adapters.alerts(spark, d), pages.DELAYS).select("alert_id", "alert_type"))


@query
def trips_with_alerts_semi(spark, d):
    return pages.trips_with_alerts(adapters.trips(spark, d), pages.deviations(adapters.alerts(spark, d))).select("trip_id", "truck_id")


@query
def historical_period_filter(spark, d):
    trips = adapters.trips(spark, d)
    kept = [("day", pages.period(trips, "day", REF_DAY)), ("week", pages.period(trips, "week", REF_DAY)), ("month", pages.period(trips, "month", REF_DAY))]
    kept += [("week-day", pages.period(trips, "week", REF_DAY, drill_day=2)), ("month-week", pages.period(trips, "month", REF_DAY, drill_week=3)), ("rolling", pages.rolling(trips, "last_month", REF_DAY))]
    out = None
    for name, rows in kept:
        one = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("trips")).withColumn("period", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def overlapping_trips(spark, d):
    return pages.overlapping(adapters.trips(spark, d), WEEK_US, WEEK_US + HOUR_US).select("trip_id", "in_us", "out_us")


@query
def plate_search(spark, d):
    return pages.by_plate(adapters.trips(spark, d), "p1").groupBy("plate").agg(F.count(F.lit(1)).alias("trips"))


@query
def latest_reads(spark, d):
    return pages.latest(_reads(spark, d), "at_us").select("trip_id", "step", "at_us", "camera_id")


@query
def iso_week_archive(spark, d):
    return pages.week_archive(adapters.trips(spark, d))


@query
def retention_cap(spark, d):
    return pages.retained(adapters.trips(spark, d), 700).select("trip_id", "site_id", "out_us")


@query
def scatter_offset(spark, d):
    points = flow.duration_points(adapters.trips(spark, d))
    return pages.scatter_offset(points, "hour").select("trip_id", "x_shown")


@query
def text_codes(spark, d):
    text = F.concat(F.lit("CIR_"), F.col("circuit"), F.lit("_V0 en "), F.col("plate"), F.lit(" VUE_A1_V2, Sector "), (F.col("event_id") % 12).cast("string"), F.lit(" y S4"))
    rows = adapters.trips(spark, d).withColumn("note", text)
    return rows.select("trip_id", F.array_join(scalar.codes_in(F.col("note")), ",").alias("codes"), F.array_join(scalar.sectors_in(F.col("note")), ",").alias("sectors"))
