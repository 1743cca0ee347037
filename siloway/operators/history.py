"""Keeping history: appending completed trips, rolling weeks and months into archives, the cap, and tables by day of exit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siloway.functions.scalar import DAY_US, date_of, day_number, iso_week
from siloway.sources.storage import stored

#: Trips that a site's history keeps (fixed value).
CAP = 75_000

#: Files that the trips of one day of a site are written to at most.
DAY_FILES = 8

LOG = "batch_id long, version long, now_us long"


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of completed trips to a history partitioned by site; what is there by the checkpoint is not added twice."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("site_id").trigger(availableNow=True).start(path)


def remaining(trips: DataFrame, archived: DataFrame) -> DataFrame:
    """Trips that no archive holds."""
    return trips.join(archived.select("trip_id"), "trip_id", "left_anti")


def week_of(trips: DataFrame) -> Column:
    return iso_week(F.col("out_us"))


def closed_weeks(trips: DataFrame, now_week: str) -> DataFrame:
    """Trips of ISO weeks before one, with their ``archive`` (historico_semana_ and the week), to be written by site and archive."""
    return trips.withColumn("archive", F.concat(F.lit("historico_semana_"), week_of(trips))).filter(week_of(trips) < now_week)


def closed_months(trips: DataFrame, now_month: str) -> DataFrame:
    """Trips of months before one (yyyy-MM), with their ``archive`` (historico_yyyy_MM)."""
    month = F.date_format("trip_date", "yyyy-MM")
    return trips.withColumn("archive", F.concat(F.lit("historico_"), F.date_format("trip_date", "yyyy_MM"))).filter(month < now_month)


def over_cap(trips: DataFrame, cap: int = CAP) -> DataFrame:
    """The trips of each site that its newest ``cap`` displace, in the archive's short form.

    Only the day in which the cap falls is ranked; days before it are archived whole.
    """
    days = trips.groupBy("site_id", "trip_date").agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("site_id").orderBy(F.desc("trip_date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("newer", newer).filter(F.col("newer") + F.col("n") > cap)
    rows = trips.join(days, ["site_id", "trip_date"])
    whole = rows.filter(F.col("newer") >= cap)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("out_us"), F.desc("trip_id")))
    part = rows.filter(F.col("newer") < cap).withColumn("_r", rank).filter(F.col("_r") > cap - F.col("newer")).drop("_r")
    return whole.unionByName(part).select("trip_id", "truck_id", "plate", "site_id", "circuit", "trip_date", "out_us", "duration_minutes", F.col("state").alias("classification"))


# --- rolling history -----------------------------------------------------------------------------------------------


def closes_on(trips: DataFrame) -> Column:
    """The last day of a trip's week or month, whichever is earlier: the day after it, the trip goes to an archive."""
    return F.least(F.last_day("trip_date"), F.date_add("trip_date", 6 - F.weekday("trip_date")))


def archive_of(trips: DataFrame) -> Column:
    """The archive of a trip: that of its ISO week, or of its month where that ends within the week. It follows from the trip
    alone, so trips that come late or twice go where the others of their day went."""
    monthly = F.last_day("trip_date") < F.date_add("trip_date", 6 - F.weekday("trip_date"))
    return F.when(monthly, F.concat(F.lit("historico_"), F.date_format("trip_date", "yyyy_MM"))).otherwise(F.concat(F.lit("historico_semana_"), week_of(trips)))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where none is yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *more])


def last_roll(spark: SparkSession, base: str) -> tuple[int, int, int]:
    """(batch, version, now) of the last roll that was finished; (-1, 0, 0) before the first."""
    row = _read(spark, f"{base}/log", LOG).agg(F.max(F.struct("version", "batch_id", "now_us")).alias("r")).first()["r"]
    return (row["batch_id"], row["version"], row["now_us"]) if row else (-1, 0, 0)


def live_trips(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The history that is not archived, as the last finished roll left it."""
    return _read(spark, f"{base}/live-{last_roll(spark, base)[1]}", schema)


def archived_trips(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All archived trips with their ``archive``."""
    return _read(spark, f"{base}/archives", schema + ", archive string")


def rolled(base: str, now_us: int | None = None, crash: Callable[[str], None] = lambda step: None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds a batch of completed trips to the history at ``base`` and archives what is over.

    Trips whose week or month ended before the day of ``now_us`` (the latest exit seen, if that is None) leave the live history
    for their archives. Those archives are merged with what is in them and written over, partition by partition; then the
    next version of the live history is written, which a week or a month bounds; then a row of the log makes it the one that
    readers see. A trip is kept once by its id. A batch that comes again, or again after a crash at any point, gives the
    same tables: merging twice adds nothing, an unfinished version is written over, and a finished batch is passed over.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done, version, before = last_roll(spark, base)
        if batch_id <= done:
            return
        schema = _ddl(batch)
        rows = stored(live_trips(spark, base, schema).unionByName(batch).dropDuplicates(["trip_id"]), f"{base}/stage-rows")
        now = now_us if now_us is not None else max(before, rows.agg(F.max("out_us")).first()[0] or 0)
        over = closes_on(rows) < date_of(F.lit(now))
        closed = rows.filter(over).withColumn("archive", archive_of(rows))
        touched = closed.select("site_id", "archive").distinct()
        merged = closed.unionByName(archived_trips(spark, base, schema).join(touched, ["site_id", "archive"], "left_semi")).dropDuplicates(["trip_id"])
        merged = stored(merged, f"{base}/stage-archives")
        merged.repartition("site_id", "archive", F.pmod(F.xxhash64("trip_id"), F.lit(DAY_FILES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id", "archive").parquet(f"{base}/archives")
        crash("archived")
        rows.filter(~over).write.mode("overwrite").parquet(f"{base}/live-{version + 1}")
        crash("removed")
        spark.createDataFrame([(batch_id, version + 1, now)], LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")

    return run


def roll_stream(stream: DataFrame, base: str, checkpoint: str, now_us: int | None = None) -> StreamingQuery:
    """Keep a history at ``base`` from a stream of completed trips."""
    return stream.writeStream.foreachBatch(rolled(base, now_us)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- history by day of exit ----------------------------------------------------------------------------------------


def write_by_day(trips: DataFrame, path: str) -> DataFrame:
    """The history partitioned by site and day of exit; a day of a site is a few files, however busy."""
    dealt = trips.repartition("site_id", "trip_date", F.pmod(F.xxhash64("trip_id"), F.lit(DAY_FILES)))
    dealt.write.mode("overwrite").partitionBy("site_id", "trip_date").parquet(path)
    return trips.sparkSession.read.schema(trips.schema).parquet(path)


def reference_by_day(history: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, max_out_us, ref_day) as ``detail.reference_days``, from the names of partitions and the trips of each site's last day."""
    from siloway.operators.detail import DEFAULT_REFERENCE_US

    last = history.groupBy("site_id").agg(F.max("trip_date").alias("trip_date"))
    newest = history.join(F.broadcast(last), ["site_id", "trip_date"]).groupBy("site_id").agg(F.max("out_us").alias("max_out_us"))  # a row per site
    found = sites.select("site_id").join(newest, "site_id", "left").fillna(DEFAULT_REFERENCE_US, ["max_out_us"])
    return found.withColumn("ref_day", day_number(F.col("max_out_us")))


def days_of(references: DataFrame, kind: str, drill_day: int | None = None, drill_week: int | None = None) -> DataFrame:
    """(site_id, trip_date): the days of a period (``pages.period``: day, week, month; ``pages.rolling``: last_day, last_week,
    last_month) up to each site's reference day. Thirty-one a site at most."""
    ref = F.date_add(F.lit("1970-01-01").cast("date"), F.col("ref_day"))
    first, last = ref, ref
    if kind in ("week", "last_week"):
        first, last = F.date_sub(ref, 6), ref
        if drill_day is not None:
            first = last = F.date_sub(ref, drill_day)
    elif kind == "last_month":
        first = F.date_sub(ref, 30)
    elif kind == "month":
        first, last = F.trunc(ref, "month"), F.last_day(ref)
        if drill_week is not None:
            newest = F.date_sub(last, (4 - drill_week) * 7)
            first, last = (F.date_sub(newest, 6), newest) if drill_day is None else (F.date_sub(newest, drill_day),) * 2
    days = references.select("site_id", last.alias("_last"), F.explode(F.sequence(first, last)).alias("trip_date"))
    # true of every row: partitions are pruned at run time only by a side with a comparison
    return days.filter(F.col("trip_date") <= F.col("_last")).select("site_id", "trip_date")


def of_days(history: DataFrame, days: DataFrame) -> DataFrame:
    """The trips of those days of those sites; only their partitions are read. ``days`` is bounded (``days_of``), so it is broadcast."""
    return history.join(F.broadcast(days), ["site_id", "trip_date"], "left_semi")


def overlapping_by_day(history: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Trips that overlap [start, end): days of exit before the range's first are not read."""
    from siloway.operators.pages import overlapping

    return overlapping(history.filter(F.col("trip_date") >= date_of(F.lit(start_us // DAY_US * DAY_US))), start_us, end_us)
