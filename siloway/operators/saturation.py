"""Sector occupancy: trips to sector intervals, concurrent occupancy, episodes over capacity, bucket heatmap, summaries.

All instants are integer microseconds, so adjoining segments share exact ends. A sector's sweep is keyed by (site,
sector, chunk): the line of time is cut into chunks, occupancy carried into a chunk is a prefix sum of the chunks'
net changes, and so a busy sector is swept by as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.scalar import DAY_US, HOUR_US, MINUTE_US, alert_category, hour_of, sector_order, utilisation_band
from siloway.operators.visits import once

#: Length of a chunk of the sweep.
CHUNK_US = DAY_US


def trip_segments(trips: DataFrame) -> DataFrame:
    """Trips with ``segments``: a trip's stay divided over its sectors, as (step, sector, start_us, end_us, first).

    Weights are the known minutes of the sectors, unknown ones counting as the mean of the known; without any known
    they are equal. A stay that is not positive is taken as the clamped minutes. Empty segments are left out; ``first`` tells
    whether a segment is the trip's first in its sector. Each step of the sums is held, so that none is worked out again for
    every element.
    """
    span = F.when(F.col("out_us") > F.col("in_us"), F.col("out_us") - F.col("in_us")).otherwise((F.col("stay") * MINUTE_US).cast("long"))
    raw = F.transform("sectors", lambda s: F.greatest(F.lit(0.0), F.coalesce(F.element_at("sector_minutes", s), F.lit(0.0))))
    rows = once(trips.filter(F.size("sectors") > 0).withColumn("_span", span).withColumn("_raw", raw), ["_span", "_raw"])
    known, total = F.size(F.filter("_raw", lambda w: w > 0)), F.aggregate("_raw", F.lit(0.0), lambda a, w: a + w)
    rows = once(rows.withColumn("_known", known).withColumn("_total", total), ["_known", "_total"])
    # times the number of known weights, so that the mean of the known is their sum and no division rounds it
    weights = F.transform("_raw", lambda w: F.when(F.col("_known") == 0, 1.0).when(w > 0, w * F.col("_known")).otherwise(F.col("_total")))
    sums = F.aggregate(weights, F.array(F.lit(0.0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
    rows = once(rows.withColumn("_upto", sums), ["_upto"])
    edges = F.transform("_upto", lambda u: F.col("in_us") + F.floor(F.col("_span") * u / F.element_at("_upto", -1)).cast("long"))
    rows = once(rows.withColumn("_edge", edges), ["_edge"])
    cut = F.transform("sectors", lambda s, i: F.struct(i.alias("step"), s.alias("sector"), F.get("_edge", i).alias("start_us"), F.get("_edge", i + 1).alias("end_us")))
    kept = F.filter(cut, lambda x: (x["end_us"] > x["start_us"]) & (x["sector"] != ""))
    rows = once(rows.withColumn("_kept", kept), ["_kept"])
    named = F.transform("_kept", lambda x, i: F.struct(x["step"].alias("step"), x["sector"].alias("sector"), x["start_us"].alias("start_us"), x["end_us"].alias("end_us"), (F.array_position(F.col("_kept")["sector"], x["sector"]) == i + 1).alias("first")))
    return rows.withColumn("segments", named).drop("_span", "_raw", "_known", "_total", "_upto", "_edge", "_kept")


def sector_intervals(trips: DataFrame) -> DataFrame:
    """(trip_id, site_id, sector, step, start_us, end_us): the segments of trips (``trip_segments``), a row each."""
    rows = trip_segments(trips).select("trip_id", "site_id", F.explode("segments").alias("s"))
    return rows.select("trip_id", "site_id", "s.sector", "s.step", "s.start_us", "s.end_us")


def clipped(intervals: DataFrame, start_us: int, end_us: int) -> DataFrame:
    cut = intervals.withColumn("start_us", F.greatest("start_us", F.lit(start_us))).withColumn("end_us", F.least("end_us", F.lit(end_us)))
    return cut.filter("end_us > start_us")


def occupancy(intervals: DataFrame, by: list[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """(by, at_us, change, occupied): the occupancy after each instant at which it changes.

    Changes at one instant are summed first, which puts ends before starts: an interval is half-open.
    """
    changes = intervals.select(*by, F.explode(F.array(F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at_us"), F.lit(-1).alias("d")))).alias("e"))
    steps = changes.groupBy(*by, F.col("e.at_us").alias("at_us")).agg(F.sum("e.d").alias("change"))
    steps = steps.withColumn("chunk", F.expr(f"at_us div {chunk_us}"))
    nets = steps.groupBy(*by, "chunk").agg(F.sum("change").alias("net"))
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = nets.select(*by, "chunk", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("carried"))
    within = Window.partitionBy(*by, "chunk").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("inside", F.sum("change").over(within)).join(carried, [*by, "chunk"]).select(*by, "chunk", "at_us", "change", (F.col("carried") + F.col("inside")).alias("occupied"))


def peaks(moves: DataFrame, by: list[str], sums: list[str], chunk_us: int = CHUNK_US) -> DataFrame:
    """(by, peak, sums): the greatest occupancy out of moves (by, at_us, change), and the totals of other columns of theirs.

    A chunk of time is swept on its own and gives its net change and its greatest rise; only chunks are then put in order.
    """
    steps = moves.groupBy(*by, "at_us").agg(*[F.sum(c).alias(c) for c in ("change", *sums)]).withColumn("chunk", F.expr(f"at_us div {chunk_us}"))
    rise = F.sum("change").over(Window.partitionBy(*by, "chunk").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0))
    chunks = steps.withColumn("rise", rise).groupBy(*by, "chunk").agg(F.max("rise").alias("rise"), *[F.sum(c).alias(c) for c in ("change", *sums)])
    before = F.coalesce(F.sum("change").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("most", before + F.col("rise")).groupBy(*by).agg(F.max("most").alias("peak"), *[F.sum(c).alias(c) for c in sums])


def peak_concurrent(intervals: DataFrame, by: list[str]) -> DataFrame:
    ends = F.array(F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("change")), F.struct(F.col("end_us").alias("at_us"), F.lit(-1).alias("change")))
    return peaks(intervals.select(*by, F.explode(ends).alias("e")).select(*by, "e.*"), by, [])


def episodes(intervals: DataFrame, capacity: DataFrame) -> DataFrame:
    """Maximal spans of a sector with occupancy over its capacity.

    A stretch of steps over capacity is first reduced within its chunk of time: its first step, its last, its greatest
    occupancy, and whether it goes on in the next chunk. Only these pieces, not the steps, are then chained by sector.
    """
    by = ["site_id", "sector"]
    levels = occupancy(intervals, by).join(F.broadcast(capacity.filter("capacity > 0")), by)
    order = Window.partitionBy(*by, "chunk").orderBy("at_us")
    levels = levels.withColumn("over", F.col("occupied") > F.col("capacity"))
    # the state before the first step of a chunk is its occupancy less the change
    was = F.when(F.row_number().over(order) == 1, F.col("occupied") - F.col("change") > F.col("capacity")).otherwise(F.lag("over").over(order))
    levels = levels.withColumn("was", was).withColumn("piece", F.sum(F.when(F.col("over") & ~F.col("was"), 1).otherwise(0)).over(order))
    pieces = levels.filter("over or was").groupBy(*by, "capacity", "chunk", "piece").agg(
        F.min(F.when(F.col("over") & ~F.col("was"), F.col("at_us"))).alias("opened"), F.max(F.when(~F.col("over"), F.col("at_us"))).alias("closed"),
        F.max(F.when(F.col("over"), F.col("occupied"))).alias("most"), F.min("at_us").alias("at"),
    )
    island = F.count("opened").over(Window.partitionBy(*by).orderBy("chunk", "piece"))
    spans = pieces.withColumn("island", island).groupBy(*by, "capacity", "island").agg(F.min("at").alias("start_us"), F.max("closed").alias("end_us"), F.max("most").alias("max_occupancy"))
    pct = F.col("max_occupancy") / F.col("capacity") * 100
    return spans.filter("end_us is not null").select(
        *by, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / MINUTE_US).alias("minutes"), "max_occupancy", "capacity",
        (F.col("max_occupancy") - F.col("capacity")).alias("max_excess"), pct.alias("max_utilization_pct"), F.when(pct >= 120, "severe").otherwise("moderate").alias("severity"),
    )


def heatmap(intervals: DataFrame, capacity: DataFrame, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """Greatest occupancy of each sector in each bucket of a range, its utilisation and band; zero-filled for sectors with data.

    An interval is exploded to the buckets it touches and clipped to each, so the sweep is keyed by (sector, bucket).
    """
    inside = clipped(intervals, start_us, end_us)
    touched = inside.withColumn("bucket", F.explode(F.expr(f"sequence((start_us - {start_us}) div {step_us}, (end_us - 1 - {start_us}) div {step_us})")))
    left = F.col("bucket") * step_us + start_us
    cut = touched.withColumn("start_us", F.greatest("start_us", left)).withColumn("end_us", F.least("end_us", left + step_us))
    busy = occupancy(cut, ["site_id", "sector", "bucket"], chunk_us=1 << 60).groupBy("site_id", "sector", "bucket").agg(F.max("occupied").alias("occupancy"))
    n = -(-(end_us - start_us) // step_us)
    spine = inside.select("site_id", "sector").distinct().crossJoin(intervals.sparkSession.range(n).withColumnRenamed("id", "bucket"))
    full = spine.join(busy, ["site_id", "sector", "bucket"], "left").fillna(0, ["occupancy"]).join(F.broadcast(capacity), ["site_id", "sector"], "left")
    use = F.col("occupancy") / F.col("capacity")
    return full.select("site_id", "sector", "bucket", "occupancy", "capacity", use.alias("utilization"), utilisation_band(use).alias("band"))


def summaries(found: DataFrame, cells: DataFrame, step_us: int) -> DataFrame:
    """Per sector: episodes, saturated minutes exact and by bucket, longest, greatest excess, critical hour, status."""
    by = ["site_id", "sector"]
    buckets = cells.groupBy(*by).agg((F.count_if(F.col("band").isin("saturated", "severe")) * (step_us / MINUTE_US)).alias("bucket_minutes"))
    totals = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"), F.max("minutes").alias("longest_minutes"), F.max("max_excess").alias("max_excess")
    )
    hours = found.groupBy(*by, hour_of(F.col("start_us")).alias("hour")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"), F.min("start_us").alias("first"))
    critical = hours.groupBy(*by).agg(F.max_by("hour", F.struct(F.col("us"), -F.col("first"))).alias("hour"))
    full = buckets.join(totals, by, "left").join(critical, by, "left").fillna(0, ["episodes", "us", "longest_minutes", "max_excess"])
    minutes = F.col("us") / MINUTE_US
    status = (
        F.when(F.col("episodes") == 0, "sin_saturacion")
        .when((minutes >= 240) | (F.col("episodes") >= 8) | (F.col("max_excess") >= 10), "critico")
        .when((minutes >= 60) | (F.col("episodes") >= 3) | (F.col("max_excess") >= 4), "alto")
        .otherwise("moderado")
    )
    label = F.when(F.col("hour").isNull(), "—").otherwise(F.format_string("%02d:00–%02d:00", "hour", (F.col("hour") + 1) % 24))
    return full.select(*by, "episodes", minutes.alias("saturated_minutes"), "longest_minutes", "max_excess", "bucket_minutes", label.alias("critical_hour"), status.alias("status"))


def executive(summary: DataFrame) -> DataFrame:
    """Per site: sectors with episodes, episodes, saturated minutes, and the sector with most of them, of equal ones the first."""
    rank = F.struct(F.round("saturated_minutes", 6), "episodes", "max_excess", (-sector_order(F.col("sector"))).alias("o"))
    return summary.groupBy("site_id").agg(
        F.count_if(F.col("episodes") > 0).alias("saturated_sectors"), F.sum("episodes").alias("episodes"), F.sum("saturated_minutes").alias("saturated_minutes"),
        F.max_by(F.when(F.col("episodes") > 0, F.col("sector")), rank).alias("top_sector"), (F.max("saturated_minutes") / 60).alias("top_sector_hours"),
    )


def simultaneous(found: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """How many pairs of episodes of two sectors of a site overlap in time, by pair of sectors; pairs are counted, not made.

    An episode overlaps those of the other sector that start before its end, less those that end by its start. Both are
    running counts over the other sector's sorted edges, among which an episode asks once for each other sector of its site,
    so the work is episodes times sectors. Running counts go by chunk of time, as in a sweep.
    """
    sectors = found.select("site_id", F.col("sector").alias("other")).distinct()
    asking = found.join(F.broadcast(sectors), "site_id").filter("sector < other").select("site_id", F.col("sector").alias("sector_a"), F.col("other").alias("sector_b"), "start_us", "end_us")

    def point(kind: int, at: str, place: int, weight: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at_us"), F.lit(place).alias("place"), F.lit(weight).alias("weight"))

    # of one instant: who asks for starts before it, then edges, then who asks for ends up to it
    asked = asking.select("site_id", "sector_a", "sector_b", F.explode(F.array(point(0, "end_us", 0, 0), point(1, "start_us", 2, 0))).alias("p"))
    edges = found.select("site_id", F.lit(None).cast("string").alias("sector_a"), F.col("sector").alias("sector_b"), F.explode(F.array(point(0, "start_us", 1, 1), point(1, "end_us", 1, 1))).alias("p"))
    points = asked.unionByName(edges).select("site_id", "sector_a", "sector_b", "p.*").withColumn("chunk", F.expr(f"at_us div {chunk_us}"))
    line = ["site_id", "sector_b", "kind"]
    held = points.groupBy(*line, "chunk").agg(F.sum("weight").alias("edges"))
    earlier = F.sum("edges").over(Window.partitionBy(*line).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*line, "chunk", F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.sum("weight").over(Window.partitionBy(*line, "chunk").orderBy("at_us", "place").rowsBetween(Window.unboundedPreceding, 0))
    told = points.withColumn("within", within).filter("sector_a is not null").join(held, [*line, "chunk"])
    count = F.when(F.col("kind") == 0, F.col("before") + F.col("within")).otherwise(-(F.col("before") + F.col("within")))
    return told.groupBy("site_id", "sector_a", "sector_b").agg(F.sum(count).alias("overlap_count")).filter("overlap_count > 0")


def sector_density(trips: DataFrame, alerts: DataFrame, capacity: DataFrame) -> DataFrame:
    """Per site and sector: peak occupancy, trips through it, their mean stay, alerts, capacity, and whether the peak reaches it.

    Trips are read and divided once: the moves of a segment carry its trip where it is the trip's first in the sector.
    """
    by = ["site_id", "sector"]
    rows = trip_segments(trips).select("site_id", "stay", F.explode("segments").alias("s"))
    come = F.struct(F.col("s.start_us").alias("at_us"), F.lit(1).alias("change"), F.col("s.first").cast("long").alias("trips"), F.when(F.col("s.first"), F.col("stay")).otherwise(0.0).alias("stays"))
    go = F.struct(F.col("s.end_us").alias("at_us"), F.lit(-1).alias("change"), F.lit(0).cast("long").alias("trips"), F.lit(0.0).alias("stays"))
    moves = rows.select("site_id", F.col("s.sector").alias("sector"), F.explode(F.array(come, go)).alias("m")).select(*by, "m.*")
    zero = F.lit(0).cast("long")
    busy = peaks(moves, by, ["trips", "stays"]).select(*by, F.col("peak").cast("long").alias("peak"), "trips", "stays", zero.alias("alerts"))
    alerted = alerts.filter("sector is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("alerts")).select(*by, zero.alias("peak"), zero.alias("trips"), F.lit(0.0).alias("stays"), "alerts")
    full = busy.unionByName(alerted).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("peak", "trips", "stays", "alerts")]).join(F.broadcast(capacity), by, "left")
    mean = F.when(F.col("trips") > 0, F.col("stays") / F.col("trips")).otherwise(0.0)
    return full.select(*by, "peak", "trips", mean.alias("mean_stay"), "alerts", "capacity", F.coalesce(F.col("peak") >= F.col("capacity"), F.lit(False)).alias("saturated"))


def detail_window(found: DataFrame, step_us: int, range_start: int, range_end: int) -> DataFrame:
    """Each episode with the window shown around it: twice its span or four buckets on each side, within the range."""
    margin = F.greatest(2 * (F.col("end_us") - F.col("start_us")), F.lit(4 * step_us))
    return found.withColumn("window_start", F.greatest(F.lit(range_start), F.col("start_us") - margin)).withColumn("window_end", F.least(F.lit(range_end), F.col("end_us") + margin))


def markers(alerts: DataFrame, start_us: int, end_us: int, sector: str | None = None) -> DataFrame:
    """Alerts in [start, end) with their operational category; those without a sector pass a sector filter."""
    rows = alerts.filter((F.col("at_us") >= start_us) & (F.col("at_us") < end_us))
    if sector is not None:
        rows = rows.filter(F.col("sector").isNull() | (F.col("sector") == sector))
    return rows.select("alert_id", "site_id", "at_us", alert_category(F.col("alert_type")).alias("category"), "alert_type", "sector")


def narrative(summary: DataFrame, found: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(site_id, rule, sentence): which sector is worst, at what hour, and which sectors saturate together."""
    top = executive(summary).filter("top_sector is not null")
    best = summary.filter("episodes > 0").join(top.select("site_id", F.col("top_sector").alias("sector")), ["site_id", "sector"])
    worst = best.select(
        "site_id", F.lit(1).alias("rule"),
        F.format_string("%s fue el sector más comprometido: %d episodio(s) y %.1f h con ocupación por encima de la capacidad.", "sector", "episodes", F.col("saturated_minutes") / 60).alias("sentence"),
    )
    hours = found.groupBy("site_id", hour_of(F.col("start_us")).alias("hour")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    hours = hours.groupBy("site_id").agg(F.max_by("hour", F.struct(F.col("us"), -F.col("hour"))).alias("hour"))
    when = hours.select("site_id", F.lit(2).alias("rule"), F.format_string("La mayor concentración de minutos saturados se observa alrededor de las %02d:00 (según inicio de episodios).", "hour").alias("sentence"))
    pair = overlaps.groupBy("site_id").agg(F.max_by(F.struct("sector_a", "sector_b"), F.struct("overlap_count", "sector_a", "sector_b")).alias("p"))
    both = pair.select("site_id", F.lit(3).alias("rule"), F.format_string("Se observa solapamiento temporal de episodios de saturación entre %s y %s.", "p.sector_a", "p.sector_b").alias("sentence"))
    return worst.unionByName(when).unionByName(both)


def analysis(trips: DataFrame, capacity: DataFrame, start_us: int, end_us: int, step_us: int = HOUR_US) -> dict[str, DataFrame] | None:
    """The whole analysis of a range by name: intervals, episodes, heatmap, summaries, executive, simultaneous, flow.

    None for an empty range. A table of capacities without rows gives no episodes and normal cells.
    """
    from siloway.operators.flow import flow_by_bucket

    if end_us <= start_us:
        return None
    near = trips.filter((F.col("out_us") > start_us) & (F.col("in_us") < end_us))
    inside = clipped(sector_intervals(near), start_us, end_us)
    found, cells = episodes(inside, capacity), heatmap(inside, capacity, start_us, end_us, step_us)
    summary = summaries(found, cells, step_us)
    return {
        "intervals": inside, "episodes": found, "heatmap": cells, "summaries": summary, "executive": executive(summary), "simultaneous": simultaneous(found), "flow": flow_by_bucket(near, start_us, end_us, step_us),
    }
