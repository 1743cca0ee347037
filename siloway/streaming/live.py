"""Structured Streaming forms of the batch operators: bucketed flow, silent trucks, truck trips with alerts, visits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siloway.operators import state, visits

EXITS = ("S3", "S10")

#: Minutes without a read after which a truck's trip is over: the longest stay.
QUIET_MINUTES = 1440

#: The state store that list states and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

READS = "at_us long, step int, sector string, camera_id string, truck_id long, plate string, site_id string, circuit string"


def flow_stream(events: DataFrame, late: str = "10 minutes", bucket: str = "1 hour") -> DataFrame:
    """Reads per site and hour of an event stream (site_id, at timestamp), closed by the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", bucket), "site_id").agg(F.count(F.lit(1)).alias("reads")).select(F.col("window.start").alias("start"), "site_id", "reads")


def silent_trucks(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(truck_id, last_sector, last_seen, reads) of trucks that go silent for so long without having left.

    State per truck is its last read and count; an event-time timer reports it when the watermark passes.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, sector, n = state.get
            state.remove()
            yield pd.DataFrame({"truck_id": [key[0]], "last_sector": [sector], "last_seen": [pd.Timestamp(last, unit="ms")], "reads": [n]})
            return
        last, sector, n = state.get if state.exists else (0, "", 0)
        for batch in batches:
            n += len(batch)
            newest = batch.loc[batch["at"].idxmax()]
            ms = int(newest["at"].timestamp() * 1000)
            if ms >= last:
                last, sector = ms, newest["sector"]
        if sector in EXITS:
            if state.exists:
                state.remove()
            return
        state.update((last, sector, n))
        # a timer must lie beyond the watermark
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("at", late)
        .groupBy("truck_id")
        .applyInPandasWithState(follow, "truck_id string, last_sector string, last_seen timestamp, reads long", "last long, sector string, reads long", "append", GroupStateTimeout.EventTimeTimeout)
    )


class _Gather(StatefulProcessor):
    """Keeps a trip's reads in a list state until none has come for ``quiet_ms``, then hands them on and forgets them."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getListState("reads", READS)
        self.due = handle.getValueState("due", "due_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (the engine's names)
        columns = [c.split(" ")[0] for c in READS.split(", ")]
        due = self.due.get()[0] if self.due.exists() else None
        last = 0
        for batch in rows:
            kept = batch[columns].astype(object).where(batch[columns].notna(), None)
            self.reads.appendList([*kept.itertuples(index=False, name=None)])
            last = max(last, int(batch["at_us"].max()) // 1000)
        new = max(last + self.quiet_ms, due or 0)
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
            self.due.update((new,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reads = sorted(self.reads.get(), key=lambda r: (r[0], r[1]))
        self.reads.clear()
        self.due.clear()
        of = [{"at_us": r[0], "step": r[1], "sector": r[2], "camera_id": r[3]} for r in reads]
        least = [min((r[i] for r in reads if r[i] is not None), default=None) for i in (4, 5, 6)]
        yield pd.DataFrame({"trip_id": [key[0]], "truck_id": [least[0]], "plate": [least[1]], "site_id": [least[2]], "circuit": [reads[0][7]], "reads": [of]})

    def close(self) -> None:
        pass


def truck_trips_stream(reads: DataFrame, expected: DataFrame, quiet_minutes: int = QUIET_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The rows of ``state.truck_trips`` out of a stream of camera reads (its columns and ``at``, a timestamp).

    A trip's reads, in whatever order, are a list state; a timer in event time ends the trip when none has come for
    ``quiet_minutes``, and its state with it. Everything after that is the batch operator's own expressions. A read that comes
    after the watermark has passed it is dropped and counted (``late_rows``). The session needs ``STORE``.
    """
    schema = "trip_id string, truck_id long, plate string, site_id string, circuit string, reads array<struct<at_us:long,step:int,sector:string,camera_id:string>>"
    gathered = reads.withWatermark("at", late).groupBy("trip_id").transformWithStateInPandas(_Gather(quiet_minutes * 60_000), schema, "append", "eventTime")
    return state.trips_of_reads(gathered, expected)


def state_alerts_stream(trips: DataFrame, now_us: int | Column) -> DataFrame:
    """The four kinds of alerts of a stream of trips, as ``state.state_alerts`` gives them."""
    return state.state_alerts(trips, now_us)


def visits_stream(events: DataFrame, late: str = "10 minutes", fallback_hours: int = 2) -> DataFrame:
    """Validated visits (``visits.trips_of``) out of a stream of gate events with ``at``, a timestamp, in any order.

    A visit's key names the half day or the shorter bucket that it lies in, so its window closes when the watermark passes
    that bucket's end, and its state goes. An event that comes later is dropped and counted (``late_rows``).
    """
    marked = events.withWatermark("at", late)
    has = F.coalesce(F.trim("visit_id"), F.lit("")) != ""
    known = visits.visits(marked.filter(has), fallback_hours, within=(F.window("at", "12 hours").alias("bucket"),))
    other = visits.visits(marked.filter(~has), fallback_hours, within=(F.window("at", f"{fallback_hours} hours").alias("bucket"),))
    return visits.trips_of_visits(known.unionByName(other).drop("bucket"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's watermark came before, in the progress that it remembers."""
    return sum(int(op["numRowsDroppedByWatermark"]) for progress in query.recentProgress for op in progress["stateOperators"])


def with_store(spark: SparkSession) -> None:
    """Set the state store that list states and timers need, for streams started from now on."""
    spark.conf.set(*STORE)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end into a memory table, for tests and small reports."""
    run(stream, name, mode)
    return stream.sparkSession.table(name)


def run(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a finite stream to its end into a memory table and give the finished query, whose progress can be asked."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
