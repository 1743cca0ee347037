"""Streams drained to the batch result, history that rolls, partitioned reads, positions, overlaps, alert log, exports; shapes of plans."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siloway.functions import dims
from siloway.functions.scalar import DAY_US, HOUR_US, MINUTE_US
from siloway.operators import alert_log, detail, history, pages, positions, saturation, state, stats, visits
from siloway.plans.detail_queries import QUERIES
from siloway.plans.queries import NOW_US, SITES
from siloway.sources import adapters, files, sinks
from siloway.streaming import live

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def put(df, path, seed):
    """Rows in random order as two files, and a last row long after all others, so that the watermark passes them."""
    df.withColumn("_r", F.rand(seed)).orderBy("_r").drop("_r").coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


# --- streams -------------------------------------------------------------------------------------------------------


def test_trips_and_alerts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    live.with_store(spark)
    trips = adapters.trips(spark, SF).filter("event_id < 120")
    reads = adapters.camera_events(trips).withColumn("at", F.timestamp_micros("at_us")).select("trip_id", "truck_id", "plate", "site_id", "circuit", "at_us", "step", "sector", "camera_id", "at")
    reads = reads.withColumn("truck_id", F.col("truck_id").cast("long")).withColumn("step", F.col("step").cast("int"))
    end = reads.agg(F.max("at_us")).first()[0] + 3 * DAY_US
    last = spark.createDataFrame([("end", 0, "P", "ricardone", "A1", end, 0, "S0", "CAM_S0")], "trip_id string, truck_id long, plate string, site_id string, circuit string, at_us long, step int, sector string, camera_id string")
    stream = put(reads, tmp_path / "in", 1)
    last.withColumn("at", F.timestamp_micros("at_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected = state.expected_of({adapters.CIRCUIT_OF[k]: v for k, v in adapters.SECTORS_OF.items()}, SITES, spark)
    query = live.run(live.truck_trips_stream(stream, expected), "trips_stream")
    got, want = spark.table("trips_stream"), state.truck_trips(reads, expected)
    columns = ["trip_id", "truck_id", "plate", "site_id", "complete", "classification", "minutes", "current_sector", "visited"]
    assert rows_of(got, *columns) == rows_of(want, *columns)
    facts = ["trip_id", "ordinal", "alert_type", "severity", "message"]
    assert rows_of(live.state_alerts_stream(got, NOW_US), *facts) == rows_of(state.state_alerts(want, NOW_US), *facts)
    assert live.late_rows(query) == 0
    left = query.lastProgress["stateOperators"][0]["customMetrics"]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4, left  # the last trip's alone: a read, its due time, a timer


def test_visits_of_a_stream_are_those_of_the_table_and_late_rows_are_counted(spark, tmp_path):
    events = adapters.gate_events(spark, SF).filter("cast(substring(doc_number, 2) as int) < 900").withColumn("at", F.timestamp_micros("at_us"))
    stream = put(events, tmp_path / "in", 2)
    most = events.agg(F.max("at")).first()[0] + timedelta(days=5)

    def one(at, doc):
        row = ("ricardone", doc, "P", doc, int(at.timestamp() * 1e6), "EXIT", None, 0, at)
        spark.createDataFrame([row], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    one(most, "end")
    query = live.run(live.visits_stream(stream), "visits_stream")
    columns = ["visit_key", "site_id", "plate", "path", "status", "flags"]
    assert rows_of(spark.table("visits_stream"), *columns) == rows_of(visits.trips_of(events), *columns)
    assert live.late_rows(query) == 0


def test_late_rows_are_counted(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    schema = "site_id string, visit_id string, plate string, doc_number string, at_us long, event_type string, lab_result string, at timestamp"

    def put_file(i, at):
        spark.createDataFrame([("s", f"v{i}", "P", "D", int(at.timestamp() * 1e6), "EXIT", None, at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put_file(0, t0)
    out = live.visits_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    counts = []
    for i, at in enumerate((None, t0 + timedelta(days=3), t0 + timedelta(hours=1))):  # the third comes two days late
        if at:
            put_file(i, at)
        query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        counts.append(live.late_rows(query))
    assert counts == [0, 0, 1]


# --- history -------------------------------------------------------------------------------------------------------

TRIP = "trip_id string, site_id string, trip_date date, out_us long, state string"


def some_trips(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        us = rng.randrange(19_700 * DAY_US, 19_765 * DAY_US)
        rows.append((f"t{seed}-{i}", rng.choice(SITES), datetime(1970, 1, 1).date() + timedelta(days=us // DAY_US), us, "VALIDADO"))
    return spark.createDataFrame(rows, TRIP)


def kept(spark, base):
    live_rows = history.live_trips(spark, base, TRIP).withColumn("archive", F.lit("live"))
    return rows_of(history.archived_trips(spark, base, TRIP).unionByName(live_rows), "trip_id", "site_id", "archive", "out_us")


def test_history_rolls_the_same_through_crashes_repeats_and_late_trips(spark, tmp_path):
    first, late = some_trips(spark, 200, 1), some_trips(spark, 80, 2)
    plain = str(tmp_path / "plain")
    for i, batch in enumerate((first.unionByName(late),)):
        history.rolled(plain, NOW_US)(batch, i)
    want = kept(spark, plain)
    assert len(want) == 280 and {r[2] for r in want} >= {"live", "historico_semana_2024-W01"}
    for step in ("archived", "removed"):
        base = str(tmp_path / step)

        def fail(at, step=step):
            if at == step:
                raise RuntimeError(at)

        with pytest.raises(RuntimeError):
            history.rolled(base, NOW_US, fail)(first, 0)
        history.rolled(base, NOW_US)(first, 0)  # the batch again
        history.rolled(base, NOW_US)(first, 0)  # and once more, though it is finished
        with pytest.raises(RuntimeError):
            history.rolled(base, NOW_US, fail)(late.unionByName(first.limit(20)), 1)
        history.rolled(base, NOW_US)(late.unionByName(first.limit(20)), 1)
        assert kept(spark, base) == want


def test_history_stream(spark, tmp_path):
    some_trips(spark, 60, 3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, base = spark.readStream.schema(TRIP).parquet(str(tmp_path / "in")), str(tmp_path / "h")
    for n in (60, 90):
        history.roll_stream(stream, base, str(tmp_path / "mark"), NOW_US).awaitTermination()
        assert len(kept(spark, base)) == n
        some_trips(spark, 30, 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_periods_read_only_their_days(spark, tmp_path):
    trips = adapters.trips(spark, SF)
    stored = history.write_by_day(trips.select("trip_id", "site_id", "trip_date", "in_us", "out_us"), str(tmp_path / "by-day"))
    references = history.reference_by_day(stored, dims.sites(spark))
    assert rows_of(references, "site_id", "max_out_us", "ref_day") == rows_of(detail.reference_days(trips, dims.sites(spark)), "site_id", "max_out_us", "ref_day")
    fixed = references.withColumn("ref_day", F.lit(19752))
    week = history.of_days(stored, history.days_of(fixed, "week"))
    assert rows_of(week, "trip_id") == rows_of(pages.period(trips, "week", 19752), "trip_id")
    assert rows_of(history.of_days(stored, history.days_of(fixed, "month", 1, 2)), "trip_id") == rows_of(pages.period(trips, "month", 19752, 1, 2), "trip_id")
    week.collect()
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1][:400]
    inside = history.overlapping_by_day(stored, NOW_US - DAY_US, NOW_US)
    assert "trip_date" in inside._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert rows_of(inside, "trip_id") == rows_of(pages.overlapping(trips, NOW_US - DAY_US, NOW_US), "trip_id")


# --- positions, overlaps, ranks, log -------------------------------------------------------------------------------


def test_positions_over_slots(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(0, 30 * HOUR_US), i) for i in range(300)] + [("a", None, 900), (None, 5, 901)]
    df = spark.createDataFrame(rows, "g string, at long, i long")
    got = positions.positioned(df, ["g"], F.floor(F.col("at") / HOUR_US), [F.col("at"), F.col("i")]).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        keys = [(-1 if r.at is None else r.at, r.i) for r in mine]
        assert keys == sorted(keys)


def test_paired_tables_have_to_be_of_one_length(spark):
    one = spark.createDataFrame([(i * HOUR_US, f"a{i}") for i in range(5)], "t long, x string")
    two = spark.createDataFrame([(i * HOUR_US * 2, f"b{i}") for i in range(5)], "u long, y string")

    def orders():
        return (F.floor(F.col("t") / HOUR_US), [F.col("t")]), (F.floor(F.col("u") / HOUR_US), [F.col("u")])

    assert rows_of(positions.paired(one, two, *orders()), "x", "y") == [(f"a{i}", f"b{i}") for i in range(5)]
    with pytest.raises(Exception, match="differ in number"):
        positions.paired(one, two.limit(4), *orders()).select("position", "x").collect()


def test_default_ids_count_through_all_plants(spark, tmp_path):
    for plant, n in (("ricardone", 2), ("avellaneda", 2)):
        (tmp_path / "live" / plant).mkdir(parents=True)
        trips = [{"endedAt": "2026-03-01T10:00:00Z", "plant": plant, "circuitCode": "Z9"} for _ in range(n)]
        (tmp_path / "live" / plant / "historico_recorridos.json").write_text(json.dumps({"data": trips}))
    got = files.Config(str(tmp_path), "live").tables(spark, NOW_US)["trips"].collect()
    assert sorted((r.trip_id, r.truck_id, r.site_id) for r in got) == [("trip-0", "truck-0", "ricardone"), ("trip-1", "truck-1", "ricardone"), ("trip-2", "truck-2", "avellaneda"), ("trip-3", "truck-3", "avellaneda")]
    assert {(r.plate, r.circuit) for r in got} == {("N/A", "N/A")}


def test_live_scenario_falls_back_while_it_is_empty(spark, tmp_path):
    (tmp_path / "march_full" / "ricardone").mkdir(parents=True)
    (tmp_path / "march_full" / "ricardone" / "historico_recorridos.json").write_text(json.dumps({"data": [{"tripId": "m"}]}))
    assert [r.trip_id for r in files.Config(str(tmp_path), "live").tables(spark)["trips"].collect()] == ["m"]


def test_overlaps_are_counted_as_pairs_are(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        a = rng.randrange(0, 4 * DAY_US, HOUR_US)  # whole hours, so that edges meet
        rows.append((rng.choice(("x", "y")), f"S{rng.randrange(4)}", a, a + rng.randrange(1, 40) * HOUR_US))
    got = {(r.site_id, r.sector_a, r.sector_b): r.overlap_count for r in saturation.simultaneous(spark.createDataFrame(rows, "site_id string, sector string, start_us long, end_us long")).collect()}
    want = {}
    for s, a, t0, t1 in rows:
        for z, b, u0, u1 in rows:
            if s == z and a < b and t0 < u1 and u0 < t1:
                want[s, a, b] = want.get((s, a, b), 0) + 1
    assert got == want


def test_scatter_offset_ranks_ten(spark):
    points = spark.range(40).select(F.lit("s").alias("site_id"), F.format_string("t%03d", "id").alias("trip_id"), F.lit(1.0).alias("hour"))
    moved = pages.scatter_offset(points, "hour")
    shown = [round(r.x_shown, 3) for r in moved.orderBy("trip_id").collect()]
    assert shown == [round(1 + min(0.08, i * 0.008), 3) for i in range(40)]
    assert "WindowGroupLimit" in QUERIES["scatter_offset"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_alert_log_folds_in_any_order(spark, tmp_path):
    schema = "alert_id string, status string, changed_us long, change_no long"
    rows = [("a", "OPEN", 5, 1), ("a", "RESOLVED", 9, 2), ("a", "ACKNOWLEDGED", 7, 3), ("b", "RESOLVED", 4, 1), ("b", "OPEN", 4, 2)]
    rng, want = random.Random(1), {("a", "RESOLVED"), ("b", "OPEN")}
    for _ in range(3):
        rng.shuffle(rows)
        log = spark.createDataFrame(rows + rows[:2], schema)
        assert {(r.alert_id, r.status) for r in alert_log.folded(log).collect()} == want
    path = str(tmp_path / "log")
    for _ in range(2):
        alert_log.record(spark.createDataFrame(rows, schema), path)
    short = alert_log.compacted(spark.read.parquet(path), str(tmp_path / "short"))
    assert short.count() == 2
    late = spark.createDataFrame([("a", "OPEN", 8, 9), ("c", "OPEN", 1, 1)], schema)
    alerts = spark.createDataFrame([("a", "OPEN", 1), ("b", "OPEN", 1), ("d", "OPEN", 1)], "alert_id string, status string, at_us long")
    assert rows_of(alert_log.with_states(alerts, short.unionByName(late)), "alert_id", "status", "updated_us") == [("a", "RESOLVED", 9), ("b", "OPEN", 4), ("d", "OPEN", 1)]


# --- exports -------------------------------------------------------------------------------------------------------


def test_csv_export_is_one_ordered_file(spark, tmp_path):
    rows = [(i, f'n{i},"q"' if i % 3 else None, i / 2) for i in range(50)]
    df = spark.createDataFrame(random.Random(1).sample(rows, 50), "i int, name string, x double").repartition(5)
    path = str(tmp_path / "out" / "report.csv")
    sinks.export_csv(df, path, ["i"], {"title": "T", "generated": "hoy", "plant": ""})
    lines = open(path).read().split("\n")
    assert lines[:3] == ["# T", "# Generado: hoy", "i,name,x"] and len(lines) == 53
    assert lines[3:6] == ["0,,0.0", '1,"n1,""q""",0.5', '2,"n2,""q""",1.0']
    assert [int(x.split(",")[0]) for x in lines[3:]] == list(range(50))
    broken = df.withColumn("x", F.when(F.col("i") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        sinks.export_csv(broken, path, ["i"])
    assert open(path).read().split("\n") == lines and [p.name for p in (tmp_path / "out").iterdir()] == ["report.csv"]
    sinks.export_csv(df.filter("i < 0"), str(tmp_path / "none.csv"), ["i"])
    assert not (tmp_path / "none.csv").exists()


def test_envelopes_by_scenario_and_plant_read_back(spark, tmp_path):
    trips = adapters.trips(spark, SF)
    rows = trips.select(F.col("trip_id").alias("tripId"), "plate", F.col("site_id").alias("plant"), adapters.iso("in_us").alias("startedAt"), adapters.iso("out_us").alias("endedAt"), F.col("sectors").alias("visitedSectors"))
    for site in SITES:
        sinks.write_envelope(rows.filter(F.col("plant") == site), str(tmp_path), "march_full", site, "historico_recorridos.json", ["endedAt", "tripId"], generated_at="x")
    back = files.Config(str(tmp_path)).tables(spark)["trips"]
    assert rows_of(back, "trip_id", "plate", "site_id", "in_us", "out_us") == rows_of(trips, "trip_id", "plate", "site_id", "in_us", "out_us")
    doc = json.loads((tmp_path / "march_full" / "ricardone" / "historico_recorridos.json").read_text())
    assert (doc["scenario"], doc["planta"], doc["generatedAt"]) == ("march_full", "ricardone", "x")
    assert [d["endedAt"] for d in doc["data"]] == sorted(d["endedAt"] for d in doc["data"])
    sinks.write_envelope(rows.filter("false"), str(tmp_path), "normal", None, "empty.json", ["tripId"])
    assert json.loads((tmp_path / "normal" / "empty.json").read_text())["data"] == []


# --- plans ---------------------------------------------------------------------------------------------------------


def test_stay_statistics_scan_trips_once(spark):
    df = QUERIES["stay_time_stats"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", plan)) == 1


def test_density_divides_trips_once(spark):
    plan = QUERIES["sector_density"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 4 and plan.count("Relation") == 2  # trips and alerts


def test_figures_of_signs_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [("a", rng.choice((-3.5, -1.0, 0.0, 0.25, 7.0, 1e6)), i) for i in range(60)] + [("b", 2.0, 1), ("c", None, 1), ("a", None, 99)]
    df = spark.createDataFrame(rows, "g string, x double, i long")
    got = {r.g: r for r in stats.figures(df, ["g"], "x", {"q": 0.37, "m": 0.5}, "i", 0.5).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.percentile("x", F.lit(0.37)).alias("q"), F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    for g in "abc":
        assert got[g].n == want[g].n
        for c in ("mean", "q", "m"):
            assert got[g][c] == pytest.approx(want[g][c]) if want[g][c] is not None else got[g][c] is None
    assert got["a"].std == pytest.approx(want["a"].std) and got["b"].std == 0
    assert got["a"].over_count == sum(1 for g, x, _ in rows if g == "a" and x is not None and x > got["a"].mean + 0.5 * got["a"].std)
    assert MINUTE_US and got["b"].mode == 2.0
