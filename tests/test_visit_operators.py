"""Operators on hand-built rows: the cases of the domain's rules, edge cases, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from siloway.functions import dims, scalar
from siloway.functions.scalar import DAY_US, HOUR_US, MINUTE_US
from siloway.operators import detail, flow, history, pages, routes, saturation, state, stats, visits
from siloway.sources import files
from siloway.streaming import live

GATE = "site_id string, visit_id string, plate string, doc_number string, at_us long, event_type string, lab_result string"
NAME = {"A": "GATE_CHECKIN", "B": "SCALE_IN", "C": "SAMPLE_SOLID_TAKEN", "D": "DISCHARGE_END", "E": "SCALE_OUT", "F": "EXIT", "G": "YARD_WAIT", "L": "LAB_RESULT_READY"}


def visit(spark, letters, lab=None, visit_id="v1", start=DAY_US + HOUR_US):
    rows = [("ricardone", visit_id, "AA1", "D1", start + i * 5 * MINUTE_US, NAME[c], lab if c == "L" else None) for i, c in enumerate(letters)]
    return visits.trips_of(spark.createDataFrame(rows, GATE)).first()


@pytest.mark.parametrize(
    "letters, lab, path, status, flags",
    [
        ("ABCLDEF", "OK", "ABCDEF", "VALID_IDEAL", []),
        ("AGBCLDEF", "OK", "AGBCDEF", "VALID_ACCEPTABLE", []),
        ("ABCLF", "NO", "ABCF", "VALID_NO_DISCHARGE", []),
        ("ABCGCLF", "NO", "ABCGCF", "VALID_NO_DISCHARGE", []),
        ("ABCLDF", "NO", "ABCDF", "INVALID", ["D_WITHOUT_OK", "INVALID_PATH"]),
        ("ABCL", "OK", "ABC", "INVALID", ["OPEN_TRIP", "D_WITHOUT_OK", "INVALID_PATH"]),
        ("ABCLDFE", "OK", "ABCDFE", "INVALID", ["OPEN_TRIP", "INVALID_PATH"]),
        ("ABCLF", "OK", "ABCF", "INVALID", ["D_WITHOUT_OK"]),
        ("CLDF", "OK", "CDF", "INVALID", ["MISSING_EVENT", "MISSING_EVENT", "INVALID_PATH"]),
        ("ABCCCCLDEF", "OK", "ABCCCDEF", "INVALID", ["D_WITHOUT_OK", "NO_CALADA_RESULT"]),
    ],
)
def test_validation(spark, letters, lab, path, status, flags):
    got = visit(spark, letters, lab)
    assert (got.path, got.status, got.flags) == (path, status, flags)


def test_visit_keys(spark):
    rows = [("s", None, "P", None, DAY_US + h * HOUR_US, "EXIT", None) for h in (10, 11, 14)] + [("s", "v", "P", None, DAY_US + h * HOUR_US, "EXIT", None) for h in (11, 13)]
    keys = [r.visit_key for r in visits.with_visit_key(spark.createDataFrame(rows, GATE)).orderBy("visit_id", "at_us").collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] != keys[4]
    assert keys[0] == "s|P|NONE|1970-01-02T10"


def test_story_tells_discharge_minutes(spark):
    rows = [("s", "v", "P", "D", 8 * HOUR_US, "UNLOAD_START", None), ("s", "v", "P", "D", 8 * HOUR_US + 25 * MINUTE_US, "UNLOAD_END", None), ("s", "v", "P", "D", 9 * HOUR_US, "GATE_CHECKOUT", None)]
    got = visits.with_story(visits.visits(spark.createDataFrame(rows, GATE))).first()
    assert got.story == "Inicio descarga 08:00:00 -> Fin descarga 08:25:00 Duración 25 min -> Egreso 09:00:00"


def test_visit_metrics(spark):
    rows = [("s", "v", "P", "D", m * MINUTE_US, e, r) for m, e, r in ((0, "GATE_CHECKIN", None), (10, "SAMPLE_SOLID_TAKEN", None), (25, "LAB_RESULT_READY", "rechazado"), (40, "EXIT", None))]
    got = visits.with_metrics(visits.visits(spark.createDataFrame(rows, GATE))).first()
    assert (got.visit_status, got.cycle_minutes, got.to_sample_minutes, got.lab_minutes, got.discharge_minutes) == ("REJECTED", 40, 10, 15, None)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], GATE)
    assert visits.trips_of(none).count() == 0
    values = spark.createDataFrame([], "k string, x double, i long")
    assert stats.stay_time_stats(values, ["k"], "x", "i").count() == 0
    assert stats.kde_curve(values, "x").count() == 0


def test_stats_of_few_values(spark):
    one = spark.createDataFrame([("a", 40.0, 1), ("b", 10.0, 2), ("b", 10.0, 3), ("b", 20.0, 1)], "k string, x double, i long")
    got = {r.k: r for r in stats.stay_time_stats(one, ["k"], "x", "i").collect()}
    assert got["a"].std == 0.0 and got["a"].over_count == 0 and got["b"].mode == 10.0
    tie = spark.createDataFrame([("a", 5.0, 2), ("a", 7.0, 1)], "k string, x double, i long")
    assert stats.mode(tie, ["k"], "x", "i").first()["mode"] == 7.0


def test_null_stay_is_the_least(spark):
    assert spark.range(1).select(scalar.clamp_minutes(F.lit(None).cast("double")).alias("m")).first().m == 30.0


def test_sweep_is_half_open(spark):
    iv = spark.createDataFrame([("s", "S1", 0, 10), ("s", "S1", 10, 20), ("s", "S1", 5, DAY_US + 15)], "site_id string, sector string, start_us long, end_us long")
    assert saturation.peak_concurrent(iv, ["site_id", "sector"]).first().peak == 2
    cap = spark.createDataFrame([("s", "S1", 1)], "site_id string, sector string, capacity int")
    (ep,) = saturation.episodes(iv, cap).collect()
    assert (ep.start_us, ep.end_us, ep.max_occupancy, ep.severity) == (5, 20, 2, "severe")


def test_episode_across_chunks(spark):
    iv = spark.createDataFrame([("s", "S1", DAY_US - 5, 3 * DAY_US), ("s", "S1", DAY_US - 3, 2 * DAY_US + 7)], "site_id string, sector string, start_us long, end_us long")
    cap = spark.createDataFrame([("s", "S1", 1)], "site_id string, sector string, capacity int")
    (ep,) = saturation.episodes(iv, cap).collect()
    assert (ep.start_us, ep.end_us) == (DAY_US - 3, 2 * DAY_US + 7)


def test_circuit_lookup_takes_the_first(spark):
    trips = spark.createDataFrame([("t1", "san_lorenzo", "A1V2"), ("t2", "ricardone", "E01"), ("t3", "avellaneda", "A1"), ("t4", "ricardone", None)], "trip_id string, site_id string, circuit string")
    got = {r.trip_id: r.circuit_code for r in routes.circuit_lookup(trips, dims.circuits(spark)).collect()}
    assert got == {"t1": "A1V0", "t2": "E1V0", "t3": None, "t4": None}


def test_state_of_a_lost_truck(spark):
    reads = spark.createDataFrame([("t", "1", "P", "ricardone", "A1", 0, 0, "S0", "CAM_S0"), ("t", "1", "P", "ricardone", "A1", MINUTE_US, 1, "S0", "CAM_S0")], "trip_id string, truck_id string, plate string, site_id string, circuit string, at_us long, step int, sector string, camera_id string")
    trips = state.truck_trips(reads, state.expected_of({"A1": "S0 S4 S7"}, ["ricardone"], spark))
    kinds = [r.alert_type for r in state.state_alerts(trips, 61 * MINUTE_US + MINUTE_US).orderBy("ordinal").collect()]
    assert kinds == ["critical_camera_missing", "unexpected_double_pass", "incomplete_route", "truck_disappeared"]


def test_flow_fills_every_hour(spark):
    trips = spark.createDataFrame([("ricardone", 5 * HOUR_US, 4 * HOUR_US)], "site_id string, in_us long, out_us long")
    rows = flow.hourly_flow(trips, dims.sites(spark)).filter("site_id = 'ricardone'").orderBy("slot").collect()
    assert len(rows) == 24 and min(r.in_plant for r in rows) == 0 and rows[4].net == -1


def test_retention_keeps_the_newest(spark):
    rows = [(f"t{i}", "s", i * HOUR_US) for i in range(60)]
    trips = spark.createDataFrame(rows, "trip_id string, site_id string, out_us long").withColumn("trip_date", scalar.date_of(F.col("out_us")))
    assert sorted(r.out_us // HOUR_US for r in pages.retained(trips, 30).collect()) == [*range(30, 60)]


def test_json_envelopes(spark, tmp_path):
    doc = {"version": "1", "generatedAt": "2026-03-31T12:00:00Z", "scenario": "normal", "data": [{"tripId": "t", "plant": "San Lorenzo", "inferredCircuitCode": "A1", "circuitCode": "Z9", "startedAt": "2026-03-01T00:00:00Z", "endedAt": "2026-03-01T01:00:00Z", "completed": True, "expectedSequence": ["S4"]}]}
    (tmp_path / "normal").mkdir()
    (tmp_path / "normal/historico_recorridos.json").write_text(json.dumps(doc))
    tables = files.load(spark, str(tmp_path), "normal")
    trip = tables["trips"].first()
    assert (trip.site_id, trip.circuit, trip.state, trip.cameras, trip.out_us - trip.in_us) == ("san_lorenzo", "A1", "VALIDADO", ["CAM_S4"], HOUR_US)
    assert tables["alerts"].count() == 0


def test_raw_rows_by_alias(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,event,location,visitId,plate,pesoBruto\n2026-01-01T10:00:00,Scale In,S1,v1,AA,12.5\n,EXIT,,,,\n2026-01-01T11:00:00,EXIT,,,,abc\n")
    rows = files.csv_samples(spark, str(tmp_path / "x.csv")).orderBy("occurred_at").collect()
    assert [(r.event_type, r.weight_kg, r.site_id) for r in rows] == [("Scale In", 12.5, "default"), ("EXIT", None, "default")]
    got = spark.range(1).select(visits.event_name(F.lit("Scale In")).alias("a"), visits.event_name(F.lit("docs ok")).alias("b")).first()
    assert (got.a, got.b) == ("SCALE_IN", "UNKNOWN")


def test_text_scalars(spark):
    row = spark.range(1).select(
        scalar.sectors_in(F.lit("CAM_RIC_S4_01 Sector 10, S1")).alias("s"), scalar.text_hash(F.lit("trip-0001")).alias("h"), scalar.product_label(F.lit(" maíz pisingallo"), F.lit("x")).alias("p"),
        scalar.site_of(F.lit("Planta San  Lorenzo")).alias("site"), scalar.path_key(F.lit("A-B (x) C")).alias("k"),
    ).first()
    assert row.s == ["S4", "S1", "S10"] and row.h == 3848669353 and row.p == "Maíz" and row.site == "san_lorenzo" and row.k == "ABC"


def _stream(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_silent_trucks(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    first = [("a", "S1", t0), ("b", "S10", t0), ("c", "S2", t0 + timedelta(hours=5))]
    df = spark.createDataFrame(first, "truck_id string, sector string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rows = live.drained(live.silent_trucks(stream), "silent").collect()
    assert [(r.truck_id, r.last_sector) for r in rows] == [("a", "S1")]


def test_flow_stream_closes_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    stream = _stream(spark, tmp_path, [("x", t0 + timedelta(minutes=40 * i)) for i in range(6)], "site_id string, at timestamp")
    rows = live.drained(live.flow_stream(stream), "flow_rows").orderBy("start").collect()
    assert [r.reads for r in rows][:2] == [2, 1]


# --- details, history, ranks ---------------------------------------------------------------------------------------


def test_ranked_quantiles_equal_percentiles(spark):
    rows = [("a", float(x)) for x in (5, 1, 1, 1, 9, 2, 2, 7)] + [("b", 3.0)] + [("c", 1e9 if x == 500 else x / 7) for x in range(501)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"p0": 0.0, "q1": 0.25, "m": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.g: r.asDict() for r in stats.ranked_quantiles(df, ["g"], "x", shares).collect()}
    want = {r.g: r.asDict() for r in df.groupBy("g").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in shares.items()]).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert all(got[g][n] == pytest.approx(want[g][n], abs=1e-9) for n in shares)
    assert stats.ranked_quantiles(df.filter("false"), ["g"], "x", shares).count() == 0
    assert stats.ranked_quantiles(df, [], "x", {"m": 0.5}).first().m == df.agg(F.percentile("x", F.lit(0.5))).first()[0]


def test_events_of_one_instant_go_by_step(spark):
    rows = [("s", "v", "P", "D", HOUR_US, e, None) for e in ("GATE_CHECKOUT", "SCALE_IN", "GATE_CHECKIN", "UNLOAD_START")]
    got = visits.visits(spark.createDataFrame(rows, GATE), ties="step").first()
    assert [e.event for e in got.events] == ["GATE_CHECKIN", "SCALE_IN", "DISCHARGE_START", "EXIT"]


def test_visit_keys_are_of_the_first_row(spark):
    rows = [("s", "v", "P9", "D", 2 * HOUR_US, "EXIT", None, 0), ("s", "v", "P1", "D", HOUR_US, "GATE_CHECKIN", None, 1)]
    assert visits.visits(spark.createDataFrame(rows, GATE + ", row_no long")).first().plate == "P9"


def test_repeated_trucks_do_not_multiply_reads(spark):
    reads = spark.createDataFrame([("A", "CAM_S1", 1)], "plate string, camera_id string, at_us long")
    cameras = spark.createDataFrame([("CAM_S1", "S1")], "camera_id string, sector string")
    trucks = spark.createDataFrame([("A", 1), ("A", 2)], "plate string, truck_id long")
    assert [r.truck_id for r in state.enrich(reads, cameras, trucks).collect()] == [2]
    with pytest.raises(Exception, match="no camera or truck"):
        state.enrich(reads, cameras, trucks.filter("false")).collect()


def test_unpaired_steps_fail(spark):
    reads, steps = spark.createDataFrame([(1, "a"), (2, "b")], "i long, r string"), spark.createDataFrame([(1, "x")], "i long, s string")
    assert state.zipped(reads.filter("i = 1"), steps, ["i"]).collect()[0].s == "x"
    with pytest.raises(Exception, match="differ in number"):
        state.zipped(reads, steps, ["i"]).collect()


def test_sites_without_trips_have_the_default_reference(spark):
    trips = spark.createDataFrame([("ricardone", 5 * DAY_US + 1)], "site_id string, out_us long")
    got = {r.site_id: r.ref_day for r in detail.reference_days(trips, dims.sites(spark)).collect()}
    assert got["ricardone"] == 5 and got["avellaneda"] == 20543


def test_history_grows_by_a_stream_once(spark, tmp_path):
    schema = "trip_id string, site_id string"
    spark.createDataFrame([("t1", "s"), ("t2", "s")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        history.append(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.trip_id for r in kept.collect()) == ["t1", "t2"]
    assert [r.trip_id for r in history.remaining(kept, kept.filter("trip_id = 't1'")).collect()] == ["t2"]


def test_normal_scenario_falls_back(spark, tmp_path):
    def put(folder, n):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "historico_recorridos.json").write_text(json.dumps({"data": [{"tripId": f"{folder}{i}"} for i in range(n)]}))

    put("normal", 2)
    assert files.Config(str(tmp_path), "normal").tables(spark)["trips"].count() == 2
    put("march_full/ricardone", 3)
    assert files.Config(str(tmp_path), "normal").tables(spark)["trips"].count() == 3


def test_empty_range_has_no_analysis(spark):
    assert saturation.analysis(spark.createDataFrame([], "site_id string"), dims.capacity(spark), 5, 5) is None
