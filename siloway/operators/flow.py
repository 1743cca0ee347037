"""Hourly flow through a plant: arrivals, departures, backlog, thresholds and runs. Spines have 24 or 168 rows per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siloway.functions.scalar import DAY_US, HOUR_US, SHIFTS, WEEKDAYS, decimal_hour, hour_of, shift_of

SATURATION, ALERT = 220, 180


def _spined(counts_in: DataFrame, counts_out: DataFrame, sites: DataFrame, slots: int) -> DataFrame:
    spine = sites.select("site_id").crossJoin(sites.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")))
    return (
        spine.join(counts_in, ["site_id", "slot"], "left").join(counts_out, ["site_id", "slot"], "left").fillna(0, ["arrivals", "departures"]).withColumn("net", F.col("arrivals") - F.col("departures"))
    )


def with_backlog(flow: DataFrame) -> DataFrame:
    """Adds ``in_plant``: the running net, lifted so that its least value is not negative. Windows run over spine rows."""
    running = F.sum("net").over(Window.partitionBy("site_id").orderBy("slot"))
    lifted = flow.withColumn("running", running)
    least = F.min("running").over(Window.partitionBy("site_id"))
    return lifted.withColumn("in_plant", F.col("running") - F.least(F.lit(0), least)).drop("running")


def hourly_flow(trips: DataFrame, sites: DataFrame) -> DataFrame:
    """Arrivals and departures by hour of day, zero-filled, with backlog."""
    arrived = trips.groupBy("site_id", hour_of(F.col("in_us")).alias("slot")).agg(F.count(F.lit(1)).alias("arrivals"))
    left = trips.groupBy("site_id", hour_of(F.col("out_us")).alias("slot")).agg(F.count(F.lit(1)).alias("departures"))
    return with_backlog(_spined(arrived, left, sites, 24))


def week_slot(us: Column, ref_day: int) -> Column:
    """Slot 0 to 167 of an instant in the seven days up to the reference day; null outside of them."""
    day = F.lit(6) - (F.lit(ref_day) - F.floor(us / F.lit(DAY_US)))
    return F.when((day >= 0) & (day <= 6), day * 24 + hour_of(us)).cast("int")


def hourly_flow_week(trips: DataFrame, sites: DataFrame, ref_day: int) -> DataFrame:
    """The same over the 168 hours up to the end of a day (given in days since 1970), with day numbers 1 to 7 and labels."""
    arrived = trips.select("site_id", week_slot(F.col("in_us"), ref_day).alias("slot")).filter("slot is not null").groupBy("site_id", "slot").agg(F.count(F.lit(1)).alias("arrivals"))
    left = trips.select("site_id", week_slot(F.col("out_us"), ref_day).alias("slot")).filter("slot is not null").groupBy("site_id", "slot").agg(F.count(F.lit(1)).alias("departures"))
    flow = with_backlog(_spined(arrived, left, sites, 168))
    return flow.withColumn("day", F.expr("slot div 24 + 1").cast("int")).withColumn("hour", F.col("slot") % 24).withColumn("label", F.format_string("D%d %02d", "day", "hour"))


def crossings(flow: DataFrame, limit: float, x: str = "in_plant") -> DataFrame:
    """How often a site's series passes between below the limit and at or above it."""
    before = F.lag(x).over(Window.partitionBy("site_id").orderBy("slot"))
    changed = flow.withColumn("changed", (before >= limit) != (F.col(x) >= limit))
    return changed.groupBy("site_id").agg(F.count_if("changed").alias("crossings"))


def runs(flow: DataFrame, condition: Column) -> DataFrame:
    """(site_id, start, end, first in_plant, last in_plant) of maximal stretches of slots that meet a condition."""
    order = Window.partitionBy("site_id").orderBy("slot")
    marked = flow.filter(condition).withColumn("island", F.col("slot") - F.row_number().over(order))
    return marked.groupBy("site_id", "island").agg(
        F.min("slot").alias("start"), F.max("slot").alias("end"), F.min_by("in_plant", "slot").alias("first"), F.max_by("in_plant", "slot").alias("last")
    )


def flow_saturation(flow: DataFrame, saturation: float = SATURATION, alert: float = ALERT) -> DataFrame:
    """Peaks, hours over the limit, longest run, ratio and crossings of a site's flow."""
    first_peak = F.max_by("slot", F.struct(F.col("in_plant"), -F.col("slot")))
    base = flow.groupBy("site_id").agg(
        F.greatest(F.lit(0), F.max("in_plant")).alias("peak"), F.when(F.max("in_plant") > 0, first_peak).otherwise(0).alias("peak_slot"),
        F.count_if(F.col("in_plant") > saturation).alias("hours_over"), F.percentile("in_plant", F.lit(0.9)).alias("p90"), F.count(F.lit(1)).alias("hours"),
        F.greatest(F.lit(0), F.max("arrivals")).alias("peak_arrivals"), F.greatest(F.lit(0), F.max("departures")).alias("peak_departures"),
        F.greatest(F.lit(0), F.max("net")).alias("max_net"), F.count_if(F.col("net") > 0).alias("hours_positive"),
        F.when(F.sum("arrivals") > 0, F.sum("departures") / F.sum("arrivals")).otherwise(0.0).alias("out_in_ratio"),
    )
    longest = runs(flow, F.col("in_plant") > saturation).groupBy("site_id").agg(F.max(F.col("end") - F.col("start") + 1).alias("recovery_hours"))
    over = crossings(flow, saturation).withColumnRenamed("crossings", "saturation_crossings")
    near = crossings(flow, alert).withColumnRenamed("crossings", "alert_crossings")
    return base.withColumn("pct_over", F.col("hours_over") / F.col("hours") * 100).join(longest, "site_id", "left").join(over, "site_id").join(near, "site_id")


def ingress_kpis(week: DataFrame, ref_day: int) -> DataFrame:
    """Arrival peak, busiest day, busiest eight-hour band, mean per hour, and the largest backlog of a week's flow."""
    names = F.array(*[F.lit(w) for w in WEEKDAYS])

    def weekday(day: Column) -> Column:
        return F.element_at(names, (F.pmod(F.lit(ref_day + 4) - (7 - day), F.lit(7)) + 1).cast("int"))

    band = F.expr("hour div 8 * 8").cast("int")
    base = week.groupBy("site_id").agg(
        F.greatest(F.lit(0), F.max("arrivals")).alias("peak_arrivals"),
        F.when(F.max("arrivals") > 0, F.max_by("slot", F.struct(F.col("arrivals"), -F.col("slot")))).otherwise(0).alias("peak_slot"),
        F.avg("arrivals").alias("arrivals_per_hour"),
    )
    days = week.groupBy("site_id", "day").agg(F.sum("arrivals").alias("n")).groupBy("site_id").agg(F.max_by("day", F.struct(F.col("n"), -F.col("day"))).alias("best_day"), F.max("n").alias("best_day_arrivals"))
    bands = week.groupBy("site_id", "day", band.alias("band")).agg(F.sum("arrivals").alias("n"), F.count(F.lit(1)).alias("hours"))
    bands = bands.groupBy("site_id").agg(F.max_by(F.struct("day", "band", "n", "hours"), F.struct(F.col("n"), -F.col("day"), -F.col("band"))).alias("b"))
    rises = runs(week, F.col("net") > 0).withColumn("backlog", F.col("last") - F.col("first")).filter("backlog > 0")
    rises = rises.groupBy("site_id").agg(F.max_by(F.struct("backlog", "start", "end"), F.struct(F.col("backlog"), -F.col("start"))).alias("r"))
    running = week.withColumn("total", F.sum("net").over(Window.partitionBy("site_id").orderBy("slot"))).filter("total > 0")
    prefix = running.groupBy("site_id").agg(F.max_by(F.struct(F.col("total").alias("backlog"), F.lit(0).alias("start"), F.col("slot").alias("end")), F.struct(F.col("total"), -F.col("slot"))).alias("p"))
    joined = base.join(days, "site_id").join(bands, "site_id").join(rises, "site_id", "left").join(prefix, "site_id", "left")
    best = F.coalesce("r", "p")
    any_day = F.col("best_day_arrivals") > 0
    return joined.select(
        "site_id", "peak_arrivals", "peak_slot", "best_day_arrivals",
        F.when(any_day, F.concat(weekday(F.col("best_day")), F.lit(" (D"), F.col("best_day"), F.lit(")"))).otherwise("—").alias("best_day"),
        F.when(any_day, F.concat(weekday(F.col("b.day")), F.format_string(" %02d–%02d", "b.band", F.col("b.band") + 8))).otherwise("—").alias("best_band"),
        F.col("b.n").alias("best_band_arrivals"), (F.col("b.n") / F.col("b.hours")).alias("best_band_per_hour"), "arrivals_per_hour",
        F.coalesce(best["backlog"], F.lit(0)).alias("backlog"), best["start"].alias("backlog_start"), best["end"].alias("backlog_end"),
    )


def stay_by_hour(trips: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean clamped stay by hour of arrival, 24 rows a site."""
    found = trips.groupBy("site_id", hour_of(F.col("in_us")).alias("hour")).agg(F.avg("stay").alias("mean_stay"), F.count(F.lit(1)).alias("trips"))
    spine = sites.select("site_id").crossJoin(sites.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")))
    return spine.join(found, ["site_id", "hour"], "left").fillna(0, ["mean_stay", "trips"])


def daily_mean(trips: DataFrame) -> DataFrame:
    return trips.groupBy("site_id", "trip_date").agg(F.avg("stay").alias("mean_stay"), F.count(F.lit(1)).alias("trips"))


def by_shift(trips: DataFrame) -> DataFrame:
    return trips.withColumn("shift", shift_of(hour_of(F.col("in_us"))))


def duration_points(trips: DataFrame) -> DataFrame:
    return trips.select("trip_id", "site_id", "plate", decimal_hour(F.col("in_us")).alias("hour"), "stay")


def flow_by_bucket(trips: DataFrame, start_us: int, end_us: int, step_us: int = HOUR_US) -> DataFrame:
    """Arrivals, departures, net and cumulative net in the half-open buckets of a range; each trip is placed by arithmetic."""
    n = -(-(end_us - start_us) // step_us)

    def counted(col: str, name: str) -> DataFrame:
        inside = trips.filter((F.col(col) >= start_us) & (F.col(col) < end_us))
        return inside.groupBy("site_id", F.expr(f"({col} - {start_us}) div {step_us}").cast("int").alias("slot")).agg(F.count(F.lit(1)).alias(name))

    flow = _spined(counted("in_us", "arrivals"), counted("out_us", "departures"), trips.select("site_id").distinct(), n)
    return flow.withColumn("cumulative", F.sum("net").over(Window.partitionBy("site_id").orderBy("slot")))


def time_buckets(spark: SparkSession, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """The half-open buckets of a range, the last one clipped: number, bounds, weekday, label, and whether it gets a tick (every six hours)."""
    rows = spark.range(-(-(end_us - start_us) // step_us)).select(F.col("id").alias("bucket"), (F.lit(start_us) + F.col("id") * step_us).alias("start_us"))
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    hour = hour_of(F.col("start_us"))
    return rows.select(
        "bucket", "start_us", F.least(F.lit(end_us), F.col("start_us") + step_us).alias("end_us"),
        F.element_at(names, (F.pmod(F.floor(F.col("start_us") / F.lit(DAY_US)) + 4, F.lit(7)) + 1).cast("int")).alias("weekday"),
        F.format_string("%02d:%02d", hour, (F.pmod(F.col("start_us"), F.lit(HOUR_US)) / F.lit(60_000_000)).cast("int")).alias("label"), (hour % 6 == 0).alias("tick"),
    )


def with_arrivals(buckets: DataFrame, trips: DataFrame, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """Buckets of a range (``time_buckets``) with the number of trips that arrive in each; a trip's bucket comes by arithmetic."""
    inside = trips.filter((F.col("in_us") >= start_us) & (F.col("in_us") < end_us)).groupBy(F.expr(f"(in_us - {start_us}) div {step_us}").alias("bucket")).agg(F.count(F.lit(1)).alias("arrivals"))
    return buckets.join(inside, "bucket", "left").fillna(0, ["arrivals"])


def flow_points(week: DataFrame | None, day: DataFrame | None) -> DataFrame | None:
    """One shape for both flows: the week's points if there is a week, else the day's."""
    if week is not None:
        return week.select("site_id", "slot", "label", "in_plant", "arrivals", "departures", "net", "hour", "day")
    if day is None:
        return None
    return day.select("site_id", "slot", F.format_string("%02d", "slot").alias("label"), "in_plant", "arrivals", "departures", "net", F.col("slot").alias("hour"), F.lit(None).cast("int").alias("day"))


def arrival_peaks(points: DataFrame) -> DataFrame:
    """All slots of a site that have its greatest number of arrivals, if that is not 0."""
    most = points.groupBy("site_id").agg(F.max("arrivals").alias("arrivals")).filter("arrivals > 0")
    return points.join(most, ["site_id", "arrivals"]).select("site_id", "slot", "label", "arrivals")


def shifts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _, _ in SHIFTS], "shift string")


def every_shift(stats: DataFrame) -> DataFrame:
    """Statistics by shift with a row for each shift, zeros for one without trips."""
    full = shifts(stats.sparkSession).join(stats, "shift", "left")
    return full.fillna(0, [c for c in stats.columns if c != "shift"])
