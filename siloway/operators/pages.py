"""Page-level queries: period filters, home, committee and plant comparison, alert lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.scalar import DAY_US, day_number, hour_of, iso_week
from siloway.operators.flow import hourly_flow
from siloway.operators.routes import states

DEVIATIONS = ("FUERA_CIRCUITO", "CONFLICTO_CIRCUITO_CAMARA")
DELAYS = ("EXCESO_TIEMPO_SECTOR", "SIN_ACTUALIZACION")


def days_before(us: Column, ref_day: int | Column) -> Column:
    """Whole days from an instant to a reference day, which may be a column (each site's own)."""
    return F.lit(ref_day) - day_number(us)


def period(trips: DataFrame, kind: str, ref_day: int | Column, drill_day: int | None = None, drill_week: int | None = None) -> DataFrame:
    """Trips whose exit lies in the day, the week or the calendar month of a reference day, or in a part drilled into.

    In a week, ``drill_day`` counts days back from the reference; in a month, ``drill_week`` 1 to 4 counts weeks up to
    the month's end, and ``drill_day`` days back within that week.
    """
    d = days_before(F.col("out_us"), ref_day)
    if kind == "day":
        return trips.filter(d == 0)
    if kind == "week":
        return trips.filter(d.between(0, 6) if drill_day is None else d == drill_day)
    ref = F.date_add(F.lit("1970-01-01").cast("date"), F.lit(ref_day))
    month = trips.filter(F.trunc("trip_date", "month") == F.trunc(ref, "month"))
    if drill_week is not None:
        back = F.datediff(F.last_day(ref), "trip_date")
        low = (4 - drill_week) * 7
        month = month.filter((back >= low) & (back < low + 7) if drill_day is None else back == low + drill_day)
    return month


def rolling(trips: DataFrame, kind: str, ref_day: int) -> DataFrame:
    """Last day, last week (7 days) or last month (31 days) by exit."""
    return trips.filter(days_before(F.col("out_us"), ref_day).between(0, {"last_day": 0, "last_week": 6, "last_month": 30}[kind]))


def overlapping(trips: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return trips.filter((F.col("out_us") > start_us) & (F.col("in_us") < end_us))


def by_plate(trips: DataFrame, part: str) -> DataFrame:
    return trips.filter(F.lower("plate").contains(part.lower()))


def filtered_alerts(alerts: DataFrame, site: str | None = None, resolved: bool | None = None, severity: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    rows = alerts
    if site:
        rows = rows.filter(F.col("site_id") == site)
    if resolved is not None:
        rows = rows.filter((F.col("status") == "RESOLVED") == resolved)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if status:
        rows = rows.filter(F.col("status") == status)
    if text:
        rows = rows.filter(F.lower(F.coalesce("sector", F.lit(""))).contains(text.lower()))
    return rows


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("site_id").agg(
        F.count_if(F.col("status") != "RESOLVED").alias("open"), F.count_if((F.col("status") != "RESOLVED") & (F.col("severity") == "CRITICAL")).alias("critical"), F.count_if(F.col("status") == "RESOLVED").alias("resolved")
    )


def deviations(alerts: DataFrame, kinds: tuple[str, ...] = DEVIATIONS) -> DataFrame:
    return alerts.filter((F.col("status") != "RESOLVED") & F.col("alert_type").isin(*kinds))


def trips_with_alerts(trips: DataFrame, alerts: DataFrame) -> DataFrame:
    return trips.join(alerts.select("truck_id"), "truck_id", "left_semi")


def home_summary(active: DataFrame, alerts: DataFrame, trips: DataFrame, sites: DataFrame, ref_day: int) -> DataFrame:
    """Per site: active trucks, open alerts of those trucks, trips closed on the reference day."""
    trucks = active.groupBy("site_id").agg(F.count(F.lit(1)).alias("active_trucks"))
    open_alerts = alerts.filter("status <> 'RESOLVED'").join(active.select("truck_id", "site_id").distinct(), ["truck_id", "site_id"], "left_semi").groupBy("site_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    closed = trips.filter(days_before(F.col("out_us"), ref_day) == 0).groupBy("site_id").agg(F.count(F.lit(1)).alias("closed"))
    full = sites.select("site_id").join(trucks, "site_id", "left").join(open_alerts, "site_id", "left").join(closed, "site_id", "left")
    return full.fillna(0, ["active_trucks", "active_alerts", "closed"])


def home_activity(trips: DataFrame, kind: str, ref_day: int, sites: list[str]) -> DataFrame:
    """Trips by slot and site as columns: hours of the reference day, days D1 to D7, or weeks S1 to S4, zero-filled."""
    d = days_before(F.col("out_us"), ref_day)
    slots, slot, keep = {
        "day": (24, hour_of(F.col("out_us")), d == 0),
        "week": (7, F.lit(6) - d, d.between(0, 6)),
        "month": (4, F.lit(3) - F.least(F.lit(3), F.expr("0") + F.floor(d / 7)), d.between(0, 30)),
    }[kind]
    counts = trips.filter(keep).groupBy(slot.cast("int").alias("slot")).pivot("site_id", sites).agg(F.count(F.lit(1)))
    return trips.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(counts), "slot", "left").fillna(0, sites)


def home_classification(trips: DataFrame, ref_day: int) -> DataFrame:
    """States by site over the reference day, eight and thirty-one days, in one pass."""
    d = days_before(F.col("out_us"), ref_day)
    spans = F.filter(F.array(F.struct(F.lit("day").alias("period"), F.lit(0).alias("days")), F.struct(F.lit("week").alias("period"), F.lit(7).alias("days")), F.struct(F.lit("month").alias("period"), F.lit(30).alias("days"))), lambda s: (d >= 0) & (d <= s["days"]))
    return states(trips.withColumn("span", F.explode(spans)).withColumn("period", F.col("span.period")), ["period", "site_id"])


def home_alerts(alerts: DataFrame, now_us: int) -> DataFrame:
    """Unresolved alerts by severity and site over the last day, week and month."""
    age = F.lit(now_us) - F.col("at_us")
    rows = alerts.filter((F.col("status") != "RESOLVED") & (age >= 0))
    return rows.groupBy("site_id", "severity").agg(*[F.count_if(age <= n * DAY_US).alias(name) for name, n in (("day", 1), ("week", 7), ("month", 30))])


def plant_comparison(trips: DataFrame, alerts: DataFrame, peak_sector: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site: trips, mean and variation of the unclamped stay, busiest sector, open critical alerts, anomalous share."""
    stays = trips.groupBy("site_id").agg(F.avg("duration_minutes").alias("mean_minutes"), (F.coalesce(F.stddev_samp("duration_minutes"), F.lit(0.0)) / F.avg("duration_minutes") * 100).alias("cv"))
    critical = alerts.filter("severity = 'CRITICAL' and status <> 'RESOLVED'").groupBy("site_id").agg(F.count(F.lit(1)).alias("critical_open"))
    top = peak_sector.groupBy("site_id").agg(F.max_by("sector", F.struct("peak", "sector")).alias("top_sector"))
    shares = states(trips, ["site_id"]).select("site_id", "trips", "anomalous_pct")
    full = sites.select("site_id").join(shares, "site_id", "left").join(stays, "site_id", "left").join(top, "site_id", "left").join(critical, "site_id", "left")
    return full.fillna(0, ["trips", "anomalous_pct", "mean_minutes", "cv", "critical_open"])


def plant_flow(trips: DataFrame, sites: DataFrame) -> DataFrame:
    return hourly_flow(trips, sites).groupBy("site_id").agg(F.sum("arrivals").alias("arrivals"), F.sum("departures").alias("departures"), F.max("in_plant").alias("max_in_plant"))


def committee(trips: DataFrame, alerts: DataFrame, peak_sector: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site: critical alerts open anywhere, anomalous and observed shares, slowest circuit, busiest sector and hour."""
    critical = alerts.agg(F.count_if((F.col("severity") == "CRITICAL") & (F.col("status") != "RESOLVED")).alias("critical_open"))
    shares = states(trips, ["site_id"]).withColumn("observed_pct", F.col("varied") / F.col("trips") * 100).select("site_id", "anomalous_pct", "observed_pct")
    slow = trips.groupBy("site_id", "circuit").agg(F.avg("duration_minutes").alias("m")).groupBy("site_id").agg(F.max_by("circuit", F.struct("m", "circuit")).alias("slowest_circuit"))
    top = peak_sector.groupBy("site_id").agg(F.max_by("sector", F.struct("peak", "sector")).alias("top_sector"))
    moves = hourly_flow(trips, sites).withColumn("moves", F.col("arrivals") + F.col("departures"))
    hour = moves.groupBy("site_id").agg(F.max_by("slot", F.struct(F.col("moves"), -F.col("slot"))).alias("peak_hour"))
    return shares.join(slow, "site_id").join(top, "site_id").join(hour, "site_id").crossJoin(F.broadcast(critical))


def latest(events: DataFrame, by: str, n: int = 48) -> DataFrame:
    """The n latest rows; a top-k report, so the limit is the feature."""
    return events.orderBy(F.desc(by), "trip_id", "step").limit(n)


def week_archive(trips: DataFrame) -> DataFrame:
    """Trips per site, ISO week and month of exit: the partitions that history is written to."""
    return trips.groupBy("site_id", iso_week(F.col("out_us")).alias("iso_week"), F.date_format("trip_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("trips"))


def retained(trips: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` trips of each site: a retention rule.

    Exits are cut to days; whole days before the cap's day are kept without ranking, only the day in which the cap falls
    is ranked, so no site's history is sorted in one task.
    """
    days = trips.groupBy("site_id", "trip_date").agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("site_id").orderBy(F.desc("trip_date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("newer", newer).filter(F.col("newer") < cap)
    rows = trips.join(days, ["site_id", "trip_date"])
    whole = rows.filter(F.col("newer") + F.col("n") <= cap)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("out_us"), F.desc("trip_id")))
    part = rows.filter(F.col("newer") + F.col("n") > cap).withColumn("_r", rank).filter(F.col("_r") <= cap - F.col("newer")).drop("_r")
    return whole.unionByName(part).drop("n", "newer")


def scatter_offset(points: DataFrame, x: str, step: float = 0.008, most: float = 0.08, reach: int = 10) -> DataFrame:
    """Points sharing a hundredth of x moved apart a little, in order of trip id.

    After ``reach`` points of a place the shift is ``most``, so only that many are ranked: the limit on the rank reaches the
    window, each task passes on so many rows of a place, and a busy place is never sorted.
    """
    place = points.withColumn("_place", F.floor(F.col(x) * 100))
    rank = F.row_number().over(Window.partitionBy("site_id", "_place").orderBy("trip_id"))
    first = place.withColumn("_nth", rank).filter(F.col("_nth") <= reach).select("trip_id", "site_id", (F.col("_nth") - 1).alias("_nth"))
    shift = F.least(F.lit(most), F.coalesce(F.col("_nth") * step, F.lit(most)))
    return points.join(first, ["trip_id", "site_id"], "left").withColumn("x_shown", F.col(x) + shift).drop("_nth")
