"""The further queries: reference days, details of saturation, orderings, readings, fleet, history, sources. Same forms as ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siloway.functions import dims, scalar
from siloway.functions.scalar import HOUR_US
from siloway.operators import alert_log, detail, fleet, flow, history, insights, pages, positions, routes, saturation, state, stats, visits
from siloway.plans.queries import MONTH_US, NOW_US, QUERIES, REF_DAY, WEEK_US, _episodes, _heatmap, _looked_up, _reads, _summaries, _truck_trips, _week_intervals, query
from siloway.plans.queries import DIVISOR as DIVISOR
from siloway.sources import adapters, files, storage

__all__ = ["QUERIES"]

# --- reference days and periods ------------------------------------------------------------------------------------


def _references(spark, d):
    return detail.reference_days(adapters.trips(spark, d), dims.sites(spark))


@query
def reference_days(spark, d):
    return _references(spark, d)


@query
def reference_ranges(spark, d):
    return detail.reference_ranges(_references(spark, d))


@query
def week_of_own_reference(spark, d):
    trips = adapters.trips(spark, d).join(F.broadcast(_references(spark, d)), "site_id")
    return pages.period(trips, "week", F.col("ref_day")).groupBy("site_id").agg(F.count(F.lit(1)).alias("trips"), F.max("out_us").alias("last_us"))


@query
def historical_scatter_x(spark, d):
    back = pages.days_before(F.col("out_us"), REF_DAY)
    hours = scalar.decimal_hour(F.col("in_us"))
    rows = adapters.trips(spark, d).filter(back.between(0, 30))
    return rows.select("trip_id", *[scalar.scatter_x(v, hours, back.cast("double")).alias(f"x_{v}") for v in ("day", "week", "month")])


@query
def trips_newest_first(spark, d):
    return detail.newest_first(adapters.trips(spark, d)).select("trip_id", "site_id", "out_us", "position")


@query
def deviations_newest_first(spark, d):
    return detail.newest_first(pages.deviations(adapters.alerts(spark, d)), "at_us", "alert_id").select("alert_id", "site_id", "at_us", "position")


# --- details of saturation -----------------------------------------------------------------------------------------


def _held(df, what):
    """``df`` written once for the parts of a query that all need it: episodes and summaries, a few rows a sector."""
    return storage.stored(df, storage.new_path(df.sparkSession, what))


def _selected(spark, d, by=("site_id", "sector"), found=None):
    windows = saturation.detail_window(_episodes(spark, d) if found is None else found, HOUR_US, WEEK_US, NOW_US)
    return detail.longest_episodes(windows, list(by))


def _inside(spark, d):
    return saturation.sector_intervals(pages.overlapping(adapters.trips(spark, d), WEEK_US, NOW_US))


@query
def detail_window_series(spark, d):
    return detail.detail_series(_selected(spark, d), _inside(spark, d), adapters.trips(spark, d), HOUR_US)


@query
def detail_marker_buckets(spark, d):
    return detail.marker_buckets(_selected(spark, d), adapters.alerts(spark, d), HOUR_US)


@query
def bucket_day_headers(spark, d):
    buckets = detail.with_day_flag(flow.time_buckets(spark, WEEK_US, NOW_US, 6 * HOUR_US)).select("bucket", "start_us", "weekday", "new_day")
    return flow.with_arrivals(buckets, adapters.trips(spark, d), WEEK_US, NOW_US, 6 * HOUR_US)


@query
def ranked_summaries(spark, d):
    return detail.ranked_summaries(_summaries(spark, d)).select("site_id", "sector", "episodes", "position")


@query
def sector_table(spark, d):
    made, summary = None, _held(_summaries(spark, d), "summaries")
    for key in detail.TABLE_KEYS:
        one = detail.sorted_table(summary, dims.sector_names(spark), dims.capacity(spark, DIVISOR), key, key != "sector").select("site_id", "sector", "sector_name", F.lit(key).alias("sort_key"), "position")
        made = one if made is None else made.unionByName(one)
    return made


@query
def timeline_order(spark, d):
    return detail.timeline_rows(_summaries(spark, d)).select("site_id", "sector", "position")


@query
def committee_sectors(spark, d):
    trips = adapters.trips(spark, d)
    density = saturation.sector_density(trips, adapters.alerts(spark, d), dims.capacity(spark))
    return detail.first_sectors(density, 8).select("site_id", "sector", "trips", "position")


@query
def saturation_reading(spark, d):
    found = _held(_episodes(spark, d), "episodes")
    summary = _held(saturation.summaries(found, _heatmap(spark, d), HOUR_US), "summaries")
    selected = _selected(spark, d, ("site_id",), found)
    series = detail.detail_series(selected, _inside(spark, d), adapters.trips(spark, d), HOUR_US)
    bounds = selected.select("site_id", F.col("start_us").alias("episode_start"), F.col("end_us").alias("episode_end"))
    alerts = adapters.alerts(spark, d).filter((F.col("at_us") >= WEEK_US) & (F.col("at_us") < NOW_US))
    return detail.reading(summary, found, saturation.simultaneous(found), alerts, series.join(F.broadcast(bounds), "site_id"), dims.sites(spark).select("site_id").unionByName(spark.createDataFrame([("sin_viajes",)], "site_id string")))


@query
def saturation_analysis(spark, d):
    parts = saturation.analysis(adapters.trips(spark, d), dims.capacity(spark, DIVISOR), WEEK_US, NOW_US)
    flows = parts["flow"].groupBy("site_id").agg(F.sum("arrivals").alias("arrivals"), F.sum("departures").alias("departures"))
    return parts["executive"].select("site_id", "saturated_sectors", "episodes", "top_sector").join(flows, "site_id")


# --- statistics ----------------------------------------------------------------------------------------------------


@query
def shape_indicators_manual(spark, d):
    return stats.shape_indicators(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0, central="iqr", tail="manual", limit=90.0)


@query
def shape_indicators_p90(spark, d):
    return stats.shape_indicators(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0, tail="p90")


@query
def histogram_overlay(spark, d):
    return stats.histogram_overlay(adapters.trips(spark, d), ["site_id"], "duration_minutes", 5.0)


def _bar_points(spark, d):
    points = adapters.trips(spark, d).filter(pages.days_before(F.col("out_us"), REF_DAY).between(0, 30))
    return detail.of_bar(points, ["A1", "E1V2"], "VALIDADO")


@query
def scatter_of_bar(spark, d):
    return _bar_points(spark, d).select("trip_id", "site_id", "circuit")


@query
def page_durations(spark, d):
    return detail.page_durations(_bar_points(spark, d), ["site_id"])


@query
def page_duration_kde(spark, d):
    return stats.kde_curve(_bar_points(spark, d).withColumn("hours", F.floor("stay") / 60), "hours", points=100, padding=0.15)


def _stay(spark, d, start_us):
    hours = adapters.trips(spark, d).filter(F.col("out_us") >= start_us).withColumn("hours", F.col("stay") / 10)
    s = stats.stay_time_stats(hours, ["site_id"], "hours", "event_id")
    return s.withColumnRenamed("mode", "moda").withColumnRenamed("median", "mediana")


@query
def radar_merged(spark, d):
    return insights.merged_radar(_stay(spark, d, WEEK_US), _stay(spark, d, MONTH_US), ["site_id"])


@query
def stay_reading(spark, d):
    hours = adapters.trips(spark, d).withColumn("hours", F.col("stay") / 60)
    shape = stats.shape_indicators(hours, ["site_id"], "hours", 0.5).join(stats.binned_mode(hours, ["site_id"], "hours", 0.5).select("site_id", F.col("binned_mode").alias("mode")), "site_id")
    return insights.stay_insights(stats.stay_time_stats(hours, ["site_id"], "hours", "event_id"), shape, ["site_id"])


@query
def stay_reading_short(spark, d):
    """Stays without indicators of shape, and a site without stays."""
    hours = adapters.trips(spark, d).withColumn("hours", F.col("stay") / 60)
    sites = dims.sites(spark).select("site_id").unionByName(spark.createDataFrame([("sin_viajes",)], "site_id string"))
    return insights.stay_insights(stats.stay_time_stats(hours, ["site_id"], "hours", "event_id"), None, ["site_id"], sites)


# --- flow ----------------------------------------------------------------------------------------------------------


def _week(spark, d):
    return flow.hourly_flow_week(adapters.trips(spark, d), dims.sites(spark), REF_DAY)


@query
def flow_points_week(spark, d):
    return flow.flow_points(_week(spark, d), None)


@query
def flow_points_day(spark, d):
    return flow.flow_points(None, flow.hourly_flow(adapters.trips(spark, d), dims.sites(spark)))


@query
def arrival_peaks(spark, d):
    return flow.arrival_peaks(flow.flow_points(_week(spark, d), None))


@query
def flow_reading(spark, d):
    return insights.flow_insights(flow.flow_saturation(_week(spark, d), saturation=12, alert=8), flow.ingress_kpis(_week(spark, d), REF_DAY))


@query
def every_shift_stats(spark, d):
    return flow.every_shift(stats.stay_time_stats(flow.by_shift(adapters.trips(spark, d)), ["shift"], "stay", "event_id"))


# --- routes --------------------------------------------------------------------------------------------------------


@query
def kpi5_destinations(spark, d):
    return routes.destinations(_looked_up(spark, d))


@query
def kpi5_multilevel_full(spark, d):
    return routes.multilevel(_looked_up(spark, d))


@query
def kpi5_reading(spark, d):
    looked = _looked_up(spark, d)
    return insights.multilevel_insight(routes.multilevel(looked), routes.operations(looked, dims.operations(spark)))


@query
def anomalous_products(spark, d):
    return routes.anomalous_products(_looked_up(spark, d))


@query
def enriched_rows(spark, d):
    return routes.enriched(_looked_up(spark, d)).select("trip_id", "catalog_code", "catalog_name", "cir", "vue", "description")


@query
def circuit_search(spark, d):
    found = fleet.search_circuits(dims.circuits(spark), " silo").select("site_id", "code", "circuit_name")
    used = _looked_up(spark, d).groupBy("site_id", F.col("circuit_code").alias("code")).agg(F.count(F.lit(1)).alias("trips"))
    return found.join(used, ["site_id", "code"], "left").fillna(0, ["trips"])


# --- dimensions and texts ------------------------------------------------------------------------------------------


@query
def camera_catalog(spark, d):
    reads = _reads(spark, d).groupBy("site_id", "sector").agg(F.count(F.lit(1)).alias("reads"))
    return dims.cameras(spark).join(reads, ["site_id", "sector"], "left").fillna(0, ["reads"])


@query
def sector_names(spark, d):
    rows = saturation.sector_intervals(adapters.trips(spark, d)).groupBy("site_id", "sector").agg(F.count(F.lit(1)).alias("segments"))
    named = rows.join(F.broadcast(dims.sector_names(spark)), ["site_id", "sector"], "left")
    return named.withColumn("sector_name", F.coalesce("sector_name", F.when(F.col("sector").rlike("^S[0-9]+$"), F.concat(F.lit("Sector "), "sector")), "sector"))


@query
def event_labels(spark, d):
    names = spark.createDataFrame([*dims.EVENT_LABELS.items()], "event string, label string")
    events = visits.normalised(adapters.full_gate_events(spark, d)).groupBy("event").agg(F.count(F.lit(1)).alias("events"))
    return events.join(F.broadcast(names), "event", "left")


@query
def truck_sector_codes(spark, d):
    n = F.col("event_id")
    last_camera = F.when(n % 3 == 0, F.concat(F.lit("cam_s"), (n % 11).cast("string")))
    last_sector = F.when(n % 3 == 1, F.concat(F.lit("Sector "), (n % 11).cast("string")))
    current = F.when(n % 4 == 2, F.lit("Balanza S4")).otherwise(F.lit("patio"))
    return adapters.trips(spark, d).select("trip_id", scalar.truck_sector_code(last_camera, last_sector, current, F.lit("CAM_S7_08")).alias("sector_code"))


@query
def tag_codes(spark, d):
    n = F.col("event_id")
    token = F.concat(F.element_at(F.array(F.lit("cir_"), F.lit("VUE_"), F.lit("PTD_")), (n % 3 + 1).cast("int")), (n % 9).cast("string"), F.lit("_V0"))
    code = F.when(n % 2 == 0, F.lit("PTD_5")).otherwise(F.lit(" VUE_4_V0"))
    return adapters.trips(spark, d).select("trip_id", scalar.mix_tag(token).alias("mix"), scalar.tag_matches(token, code).alias("matches"))


@query
def deterministic_picks(spark, d):
    return adapters.trips(spark, d).select("trip_id", scalar.deterministic_pick(["norte", "sur", "este"], F.col("trip_id")).alias("pick"))


@query
def export_names(spark, d):
    rows = adapters.trips(spark, d).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.max("trip_date").cast("string").alias("last"))
    title = F.concat(F.lit("Estadía/"), "site_id", F.lit(" (n="), "n", F.lit(")"))
    return rows.select("site_id", scalar.safe_file_name(title, F.lit("20240130_1200"), "csv").alias("file"), scalar.export_subtitle(F.col("site_id"), F.when(F.col("n") % 2 == 0, "semana"), F.col("last")).alias("subtitle"))


# --- visits --------------------------------------------------------------------------------------------------------


def _full_visits(spark, d, hours=12):
    return visits.visits(adapters.full_gate_events(spark, d), hours, ties="step")


@query
def visits_by_step(spark, d):
    rows = _full_visits(spark, d)
    return rows.select("visit_key", F.array_join(F.transform("events", lambda e: e["event"]), " ").alias("events"), F.col("plate"))


@query
def visit_metrics_full(spark, d):
    return visits.with_metrics(_full_visits(spark, d)).select(
        "visit_key", "visit_status", "cycle_minutes", "to_sample_minutes", "lab_minutes", "discharge_minutes", F.array_join("missing_steps", ",").alias("missing_steps")
    )


@query
def reconstructed_visits(spark, d):
    return visits.visit_results(visits.trips_of(adapters.gate_events(spark, d))).drop("visit_key")


@query
def sim_nodes_results(spark, d):
    return visits.sim_nodes_with_results(_full_visits(spark, d))


@query
def sim_nodes_located(spark, d):
    """Events of no known name at known places: the place gives the node."""
    n = F.col("row_no")
    other = adapters.full_gate_events(spark, d).withColumn("odd", (n % 4 == 1) & F.col("event_type").isin("SCALE_IN", "YARD_WAIT", "DISCHARGE_END", "EXIT"))
    place = F.when(F.col("event_type") == "DISCHARGE_END", F.when(n % 8 == 1, "liquid_bay_9").otherwise("PIT_2")).when(F.col("event_type") == "YARD_WAIT", " yard_b").otherwise(F.col("event_type"))
    located = other.withColumn("location", F.when(F.col("odd"), place)).withColumn("event_type", F.when(F.col("odd"), "SENSOR").otherwise(F.col("event_type")))
    return visits.sim_nodes_with_results(visits.visits(located, 12, ties="step"))


@query
def committee_circuits(spark, d):
    shown = detail.first_circuits(dims.circuits(spark), 12).select("site_id", "ordinal", "code")
    used = _looked_up(spark, d).groupBy("site_id", F.col("circuit_code").alias("code")).agg(F.count(F.lit(1)).alias("trips"))
    return shown.join(used, ["site_id", "code"], "left").fillna(0, ["trips"])


@query
def normalised_events(spark, d):
    raw = adapters.full_gate_events(spark, d).withColumn("cargo_form", F.when(F.col("row_no") % 3 == 0, "solid").when(F.col("row_no") % 3 == 1, "Gas"))
    return visits.normalised(raw).groupBy("event", "result", "cargo_form").agg(F.count(F.lit(1)).alias("events"))


# --- state, fleet and history --------------------------------------------------------------------------------------


def _fleet(spark, d):
    parked = state.in_plant(state.active(_truck_trips(spark, d)), _reads(spark, d), NOW_US, live=True)
    cameras = F.when(F.col("last_camera").isNotNull(), F.array("last_camera")).otherwise(F.expr("cast(array() as array<string>)"))
    rows = parked.withColumn("cameras", cameras).withColumn("circuit", F.when(F.col("reads") % 2 == 0, F.lit("X9")).otherwise(F.col("circuit")))
    return fleet.trucks(rows, dims.circuits(spark).unionByName(dims.circuits(spark).filter("site_id = 'san_lorenzo'").withColumn("site_id", F.lit("avellaneda"))))


@query
def fleet_trucks(spark, d):
    return _fleet(spark, d)


@query
def fleet_of_operation(spark, d):
    return fleet.of_operation(_fleet(spark, d), "RECEPCION").select("trip_id", "circuit_code")


@query
def fleet_panels(spark, d):
    return fleet.panels(_fleet(spark, d), dims.sites(spark))


@query
def fleet_panels_of_operation(spark, d):
    return fleet.panels(_fleet(spark, d), dims.sites(spark), "DESPACHANDO")


@query
def zipped_reads(spark, d):
    reads = _reads(spark, d).select("trip_id", "step", "camera_id", "at_us")
    steps = _reads(spark, d).select("trip_id", "step", F.col("sector").alias("planned"))
    return state.zipped(reads, steps, ["trip_id", "step"])


@query
def paired_reads(spark, d):
    reads = _reads(spark, d).select("trip_id", "step", "at_us")
    plan = _reads(spark, d).select(F.concat("trip_id", F.lit("/"), "step").alias("plan"), F.col("sector").alias("planned"), F.col("at_us").alias("planned_us"))
    hour = F.floor(F.col("at_us") / HOUR_US), F.floor(F.col("planned_us") / HOUR_US)
    return positions.paired(reads, plan, (hour[0], [F.col("at_us"), F.col("trip_id"), F.col("step")]), (hour[1], [F.col("planned_us"), F.col("plan")]))


@query
def state_orders(spark, d):
    return state.output_orders(_truck_trips(spark, d), NOW_US)


@query
def alert_states(spark, d):
    """Changes that come out of order and twice: an alert has as many as the last digit of its number, each later but the last."""
    n = F.col("event_id")
    each = adapters.alerts(spark, d).select("alert_id", "event_id", "at_us", F.explode(F.sequence(F.lit(0), (n % 5).cast("int"))).alias("change_no")).filter("change_no > 0")
    status = F.element_at(F.array(F.lit("ACKNOWLEDGED"), F.lit("RESOLVED"), F.lit("OPEN")), (F.pmod(n + F.col("change_no"), F.lit(3)) + 1).cast("int"))
    at = F.col("at_us") + F.when(F.col("change_no") == 4, F.lit(HOUR_US)).otherwise(F.col("change_no") * HOUR_US)
    log = each.select("alert_id", status.alias("status"), at.alias("changed_us"), F.col("change_no").cast("long").alias("change_no"))
    return alert_log.with_states(adapters.alerts(spark, d), log.unionByName(log)).select("alert_id", "site_id", "status", "updated_us")


@query
def alert_status_set(spark, d):
    return state.set_status(adapters.alerts(spark, d), "alert-9", "RESOLVED").groupBy("site_id", "status").agg(F.count(F.lit(1)).alias("alerts"), F.max("alert_id").alias("last"))


@query
def plants_union(spark, d):
    trips = adapters.trips(spark, d)
    made = None
    for site, _ in dims.SITES:
        one = trips.filter(F.col("site_id") == site).select("site_id", "trip_id", "out_us")
        made = one if made is None else made.unionByName(one, allowMissingColumns=True)
    return made


@query
def history_remaining(spark, d):
    trips = adapters.trips(spark, d)
    return history.remaining(trips, history.closed_weeks(trips, "2024-W03")).select("trip_id", "site_id", "out_us")


@query
def history_weeks(spark, d):
    return history.closed_weeks(adapters.trips(spark, d), "2024-W03").groupBy("site_id", "archive").agg(F.count(F.lit(1)).alias("trips"))


@query
def history_months(spark, d):
    return history.closed_months(adapters.trips(spark, d), "2024-02").groupBy("site_id", "archive").agg(F.count(F.lit(1)).alias("trips"))


@query
def history_over_cap(spark, d):
    return history.over_cap(adapters.trips(spark, d), 100).select("trip_id", "site_id", "circuit", "trip_date", "classification")


@query
def history_within_cap(spark, d):
    return pages.retained(adapters.trips(spark, d), history.CAP).select("trip_id", "site_id", "out_us")


@query
def history_rolled(spark, d):
    """Trips in two batches, the second with some of the first again, rolled into a history of their own."""
    trips, base = adapters.trips(spark, d).select("trip_id", "site_id", "trip_date", "out_us", "state"), storage.new_path(spark, "history")
    roll, early = history.rolled(base, NOW_US), F.col("out_us") < WEEK_US
    roll(trips.filter(early), 0)
    roll(trips.filter(~early | (F.substring("trip_id", -1, 1) == "7")), 1)
    schema = ", ".join(f"{c} {t}" for c, t in trips.dtypes)
    kept = history.archived_trips(spark, base, schema).unionByName(history.live_trips(spark, base, schema).withColumn("archive", F.lit("live")))
    return kept.groupBy("site_id", "archive").agg(F.count(F.lit(1)).alias("trips"), F.max("out_us").alias("last_us"))


def _by_day(spark, d):
    return history.write_by_day(adapters.trips(spark, d).select("trip_id", "site_id", "trip_date", "in_us", "out_us", "stay", "state"), storage.new_path(spark, "by-day"))


@query
def periods_by_day(spark, d):
    trips = _by_day(spark, d)
    references = storage.stored(history.reference_by_day(trips, dims.sites(spark)), storage.new_path(spark, "references"))
    asked = [("day", "day", None, None), ("week", "week", None, None), ("month", "month", None, None), ("last_month", "last_month", None, None), ("week-day", "week", 2, None), ("month-week", "month", None, 3), ("month-week-day", "month", 1, 3)]
    made = None
    for name, kind, day, week in asked:
        rows = history.of_days(trips, history.days_of(references, kind, day, week))
        one = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("trips"), F.max("out_us").alias("last_us"), F.avg("stay").alias("mean_stay")).withColumn("period", F.lit(name))
        made = one if made is None else made.unionByName(one)
    return made


@query
def overlapping_by_day(spark, d):
    return history.overlapping_by_day(_by_day(spark, d), WEEK_US, WEEK_US + HOUR_US).select("trip_id", "in_us", "out_us")


# --- sources -------------------------------------------------------------------------------------------------------


@query
def envelope_trips(spark, d):
    return files.historical_trips(files.unpacked(adapters.trip_envelopes(spark, d), files.HISTORY)).select("trip_id", "truck_id", "plate", "site_id", "circuit", "in_us", "out_us", "duration_minutes", "state", "trip_date")


@query
def envelope_alerts(spark, d):
    return files.operational_alerts(files.unpacked(adapters.alert_envelopes(spark, d), files.ALERTS), NOW_US).select("alert_id", "alert_type", "severity", "status", "site_id", "truck_id", "plate", "sector", "expected", "observed", "at_us", "elapsed_minutes")


@query
def envelope_events(spark, d):
    return files.enriched_events(files.unpacked(adapters.read_envelopes(spark, d), files.ENRICHED)).select("event_id", "at_us", "camera_id", "sector", "truck_id", "plate", "site_id", "circuit")


@query
def envelope_raw_events(spark, d):
    return files.unpacked(adapters.read_envelopes(spark, d), files.RAW).groupBy("plateNo", "eventType").agg(F.count(F.lit(1)).alias("reads"))


@query
def envelope_generated(spark, d):
    return files.generated_at(adapters.trip_envelopes(spark, d))


@query
def csv_event_rows(spark, d):
    rows = adapters.gate_events(spark, d).select(
        F.col("site_id").alias("siteId"), F.col("visit_id").alias("visitId"), F.concat(F.lit(" "), "plate").alias("plate"), adapters.iso("at_us").alias("timestamp"),
        F.when(F.col("row_no") % 13 != 0, F.col("event_type")).alias("event"), F.when(F.col("row_no") % 2 == 0, "12.5").otherwise("n/a").alias("pesoBruto"), F.col("lab_result").alias("resultado"),
    )
    return files.raw_event_rows(rows).select("site_id", "visit_id", "plate", "event_type", "weight_kg", "lab_result", "at_us")


@query
def csv_lines(spark, d):
    rows = adapters.trips(spark, d).groupBy("site_id", "circuit").agg(F.count(F.lit(1)).alias("trips")).select(F.concat("site_id", F.lit(', "'), "circuit", F.lit('"')).alias("name"), F.when(F.col("trips") % 2 == 0, F.col("trips")).alias("trips"))
    return files.csv_lines(rows, {"title": "Recorridos", "plant": "todas"})
