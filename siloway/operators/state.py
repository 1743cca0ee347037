"""Truck state out of camera reads: enrichment, per-truck trips, active trucks, and the four kinds of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloway.functions.scalar import HOUR_US, MINUTE_US, date_of, round_half_up
from siloway.operators.positions import positioned

CRITICAL_SECTOR, SILENT_MINUTES, ACTIVE_HOURS = "S4", 60, 4
EXIT_SECTORS = ("S3", "S10")


def zipped(reads: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Camera reads with the scenario step of the same position: both carry the position's columns; a missing partner fails
    the job when read."""
    both = reads.withColumn("_read", F.lit(True)).join(steps.withColumn("_step", F.lit(True)), by, "full")
    alone = F.col("_read").isNull() | F.col("_step").isNull()
    # the check is in a column that comes out, so that no optimiser moves or drops it
    kind = dict(both.dtypes)[by[0]]
    paired = F.when(alone, F.raise_error(F.lit("reads and steps differ in number")).cast(kind)).otherwise(F.col(by[0]))
    return both.withColumn(by[0], paired).drop("_read", "_step")


def enrich(reads: DataFrame, cameras: DataFrame, trucks: DataFrame) -> DataFrame:
    """Camera reads with the camera's site and sector and the plate's truck; a read without either fails the job when read.

    Of trucks that share a plate the one with the greatest id counts, as the last entry of a map does, so reads never multiply.
    """
    own = trucks.groupBy("plate").agg(F.max("truck_id").alias("truck_id"))
    joined = reads.join(F.broadcast(cameras), "camera_id", "left").join(own, "plate", "left")
    missing = F.col("sector").isNull() | F.col("truck_id").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no camera or truck for "), "camera_id", F.lit(" "), "plate")).cast("long")).otherwise(F.col("truck_id"))
    return joined.withColumn("truck_id", checked)


def truck_trips(reads: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per truck key: sectors in order of time, expected sequence, whether it is complete, class, minutes.

    ``reads`` has trip_id, truck_id, plate, site_id, circuit, at_us, step, sector; ``expected`` is (site_id, circuit, expected).
    A truck's reads are few, so one shuffle gathers them into a sorted array.
    """
    ordered = F.sort_array(F.collect_list(F.struct("at_us", "step", "sector", "camera_id")))
    rows = reads.groupBy("trip_id").agg(
        F.min("truck_id").alias("truck_id"), F.min("plate").alias("plate"), F.min("site_id").alias("site_id"), F.min_by("circuit", F.struct("at_us", "step")).alias("circuit"), ordered.alias("reads")
    )
    return trips_of_reads(rows, expected)


def trips_of_reads(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Trips out of gathered reads, of a table or a stream: (trip_id, truck_id, plate, site_id, circuit, reads in order of time)."""
    rows = rows.join(F.broadcast(expected), ["site_id", "circuit"], "left")
    rows = rows.withColumn("visited", F.transform("reads", lambda r: r["sector"])).withColumn("expected", F.coalesce("expected", F.expr("cast(array() as array<string>)")))
    last = F.element_at("reads", -1)
    following = F.zip_with(F.slice("visited", F.lit(1), F.size("visited") - 1), F.slice("visited", F.lit(2), F.size("visited")), lambda a, b: F.when(a == b, a))
    twice = F.get(F.filter(following, lambda s: s.isNotNull()), F.lit(0))
    rows = rows.withColumns(
        {
            "start_us": F.get("reads", F.lit(0))["at_us"],
            "end_us": last["at_us"],
            "current_sector": last["sector"],
            "current_camera": last["camera_id"],
            "complete": F.coalesce(last["sector"] == F.try_element_at("expected", F.lit(-1)), F.lit(False)),
            "critical_missing": ~F.array_contains("visited", CRITICAL_SECTOR),
            "double_pass": F.when(F.size("visited") > 1, twice),
        }
    )
    kind = F.when(F.col("critical_missing") | F.col("double_pass").isNotNull(), "ANOMALO").when(F.col("complete"), "VALIDADO").otherwise("CON_OBSERVACIONES")
    minutes = F.greatest(F.lit(0), round_half_up((F.col("end_us") - F.col("start_us")) / F.lit(MINUTE_US)))
    return rows.withColumn("classification", kind).withColumn("minutes", minutes).withColumn("trip_date", date_of(F.col("end_us")))


def active(trips: DataFrame) -> DataFrame:
    """Trucks whose trip is not complete, with their current sector and number of reads."""
    return trips.filter("not complete").select("trip_id", "truck_id", "plate", "site_id", "circuit", "current_sector", "current_camera", F.col("end_us").alias("last_seen_us"), F.size("visited").alias("reads"))


def state_alerts(trips: DataFrame, now_us: int | Column) -> DataFrame:
    """Up to four alerts per truck: critical camera missing, first double pass, incomplete route, silence of an hour or more."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    silent = F.greatest(F.lit(0), round_half_up((now - F.col("end_us")) / F.lit(MINUTE_US)))

    def alert(order: int, kind: str, severity: str, message: Column) -> Column:
        return F.struct(F.lit(order).alias("ordinal"), F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), message.alias("message"))

    rules = F.array(
        F.when(F.col("critical_missing"), alert(1, "critical_camera_missing", "high", F.lit("No se detecto paso por el nodo critico S4."))),
        F.when(F.col("double_pass").isNotNull(), alert(2, "unexpected_double_pass", "medium", F.concat(F.lit("Doble paso consecutivo por "), F.col("double_pass"), F.lit(".")))),
        F.when(~F.col("complete") & (F.size("expected") > 0), alert(3, "incomplete_route", "medium", F.lit("Recorrido aun no completo segun secuencia esperada."))),
        F.when(~F.col("complete") & (silent >= SILENT_MINUTES), alert(4, "truck_disappeared", "high", F.concat(F.lit("Sin detecciones de camara por "), silent.cast("string"), F.lit(" minutos.")))),
    )
    return trips.select("trip_id", "truck_id", "plate", "site_id", F.explode(F.filter(rules, lambda a: a.isNotNull())).alias("a")).select("trip_id", "truck_id", "plate", "site_id", "a.*")


def numbered_alerts(trips: DataFrame, now_us: int | Column) -> DataFrame:
    """Alerts with ``alert_id``: alt- and a number of four digits or more, trucks in the order of their first read, a truck's alerts
    in the order of the rules. No task numbers them all: hours of first reads are counted (``positions``)."""
    rows = state_alerts(trips, now_us).join(trips.select("trip_id", "start_us"), "trip_id")
    placed = positioned(rows.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("start_us") / HOUR_US), [F.col("start_us"), F.col("trip_id"), F.col("ordinal")])
    return placed.withColumn("alert_id", F.format_string("alt-%04d", "position")).drop("_all", "position")


def output_orders(trips: DataFrame, now_us: int | Column) -> DataFrame:
    """(list, item, position): active trucks by plate, trips by start, alerts by id as text; equal ones by trip."""
    trucks = active(trips).select(F.lit("active").alias("list"), F.col("trip_id").alias("item"), F.substring("plate", 1, 4).alias("_slot"), F.col("plate").alias("_key"), "trip_id")
    start = F.format_string("%020d", "start_us")
    started = trips.select(F.lit("trips").alias("list"), F.col("trip_id").alias("item"), F.substring(start, 1, 11).alias("_slot"), start.alias("_key"), "trip_id")
    alerts = numbered_alerts(trips, now_us).select(F.lit("alerts").alias("list"), F.col("alert_id").alias("item"), F.substring("alert_id", 1, 7).alias("_slot"), F.col("alert_id").alias("_key"), "trip_id")
    rows = trucks.unionByName(started).unionByName(alerts)
    return positioned(rows, ["list"], F.col("_slot"), [F.col("_key"), F.col("trip_id")]).select("list", "item", "position")


def in_plant(active_trucks: DataFrame, reads: DataFrame, now_us: int, live: bool = False) -> DataFrame:
    """Active trucks seen within four hours and not at an exit, with their first and last read. Live scenarios skip the hours."""
    seen = reads.groupBy("trip_id").agg(F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.max_by("camera_id", F.struct("at_us", "step")).alias("last_camera"))
    rows = active_trucks.filter(~F.col("current_sector").isin(*EXIT_SECTORS))
    if not live:
        rows = rows.filter(F.col("last_seen_us") >= now_us - ACTIVE_HOURS * HOUR_US)
    joined = rows.join(seen, "trip_id", "left")
    return joined.withColumn("first_us", F.coalesce("first_us", "last_seen_us")).withColumn("last_us", F.coalesce("last_us", "last_seen_us"))


def expected_of(circuits: dict[str, str], sites: list[str], spark) -> DataFrame:
    """(site_id, circuit, expected) from circuit code to a sequence of sectors."""
    return spark.createDataFrame([(s, c, seq.split()) for s in sites for c, seq in circuits.items()], "site_id string, circuit string, expected array<string>")


def set_status(alerts: DataFrame, alert_id: str, status: str) -> DataFrame:
    return alerts.withColumn("status", F.when(F.col("alert_id") == alert_id, status).otherwise(F.col("status")))
