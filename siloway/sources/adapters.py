"""From the test tables to the domain: trips and alerts out of ``events``, gate events out of ``orders``, camera reads out of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.functions.dims import PATHS_WITH_DISCHARGE, PATHS_WITHOUT_DISCHARGE
from siloway.functions.scalar import clamp_minutes, date_of, micros

CIRCUIT_OF = {"view": "A1", "click": "A3", "purchase": "B1", "signup": "A7", "error": "E1"}
SECTORS_OF = {"view": "S0 S1 S3 S4 S5 S7", "click": "S0 S2 S1 S3 S4 S5 S7", "purchase": "S0 S1 S2 S4 S6 S7", "signup": "S0 S1 S2 S4 S10", "error": "S0 S1 S2"}
ALERT_TYPES = [
    "FUERA_CIRCUITO", "PERDIDA_TRAZABILIDAD", "EXCESO_TIEMPO_SECTOR", "DOBLE_PASO_NO_ESPERADO", "FALTA_CAMARA_CRITICA",
    "CONFLICTO_CIRCUITO_CAMARA", "EGRESO_NO_VALIDADO", "SIN_ACTUALIZACION", "POSIBLE_CONGESTION",
]
#: Path templates of visits: the valid ones and some that break each rule.
TEMPLATES = [*PATHS_WITH_DISCHARGE, *PATHS_WITHOUT_DISCHARGE, *"ABF ABCEDF ABCDFE BCDEF ABC ABCDGEF ABGGGCDEF ACDEF ABCDEFF ABBCDEF DEF".split()]
EVENT_OF = {"A": "GATE_CHECKIN", "B": "SCALE_IN", "C": "SAMPLE_SOLID_TAKEN", "D": "DISCHARGE_END", "E": "SCALE_OUT", "F": "EXIT", "G": "YARD_WAIT"}


def pick(values: dict[str, str], key: str):
    out = F.when(F.lit(False), F.lit(""))
    for k, v in values.items():
        out = out.when(F.col(key) == k, v)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trip: ids, site, entry and exit in microseconds, raw and clamped minutes, circuit, state, sectors."""
    minutes = F.col("value")
    return (
        read(spark, sf_dir, "events")
        .select("event_id", "user_id", "event_type", "value", micros("ts").alias("in_us"))
        .select(
            F.concat(F.lit("trip-"), F.col("event_id")).alias("trip_id"),
            "event_id",
            F.col("user_id").alias("truck_id"),
            F.concat(F.lit("P"), F.col("user_id")).alias("plate"),
            F.element_at(F.array(*[F.lit(s) for s in ("ricardone", "san_lorenzo", "avellaneda")]), (F.col("user_id") % 3 + 1).cast("int")).alias("site_id"),
            "in_us",
            (F.col("in_us") + F.floor(minutes * 60_000_000 + 0.5).cast("long")).alias("out_us"),
            minutes.alias("duration_minutes"),
            clamp_minutes(minutes).alias("stay"),
            pick(CIRCUIT_OF, "event_type").alias("circuit"),
            F.when(F.col("event_id") % 10 < 7, "VALIDADO").when(F.col("event_id") % 10 < 9, "CON_OBSERVACIONES").otherwise("ANOMALO").alias("state"),
            F.split(pick(SECTORS_OF, "event_type"), " ").alias("sectors"),
            F.when(
                F.col("event_id") % 4 == 0,
                F.create_map(F.lit("S1"), (1 + F.col("event_id") % 7).cast("double"), F.lit("S4"), (2 + F.col("event_id") % 5).cast("double"), F.lit("S3"), F.lit(0.0)),
            ).alias("sector_minutes"),
            F.when(F.col("event_id") % 5 == 0, F.lit("soja premium")).when(F.col("event_id") % 5 == 1, F.lit("MAIZ")).when(F.col("event_id") % 5 == 2, F.lit("cebada")).alias("product_type"),
        )
        .withColumn("trip_date", date_of(F.col("out_us")))
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts: the error events, with type, severity, status and sector by their numbers."""
    n = F.col("event_id")
    return (
        read(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .select(
            F.concat(F.lit("alert-"), n).alias("alert_id"),
            n.alias("event_id"),
            F.col("user_id").alias("truck_id"),
            F.element_at(F.array(*[F.lit(s) for s in ("ricardone", "san_lorenzo", "avellaneda")]), (F.col("user_id") % 3 + 1).cast("int")).alias("site_id"),
            micros("ts").alias("at_us"),
            F.element_at(F.array(*[F.lit(t) for t in ALERT_TYPES]), (n % 9 + 1).cast("int")).alias("alert_type"),
            F.when(F.col("value") > 150, "CRITICAL").when(F.col("value") > 80, "HIGH").when(F.col("value") > 30, "MEDIUM").otherwise("LOW").alias("severity"),
            F.element_at(F.array(F.lit("OPEN"), F.lit("ACKNOWLEDGED"), F.lit("RESOLVED")), (n % 3 + 1).cast("int")).alias("status"),
            F.when(n % 7 != 0, F.concat(F.lit("S"), n % 11)).alias("sector"),
        )
    )


def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw gate, scale and laboratory events of visits, one row per step of the order's path template."""
    key = F.col("o_orderkey")
    path = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (key % len(TEMPLATES) + 1).cast("int"))
    start = (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 24 + key % 24) * 3_600_000_000 + 1_800_000_000
    last_c = F.length("path") - F.instr(F.reverse("path"), "C")
    with_d = F.col("path").contains("D")
    final = F.when(with_d != (key % 11 == 0), "OK").otherwise("NO")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), path.alias("path"))
    return (
        orders.select("*", F.posexplode(F.split("path", "")).alias("step", "letter"))
        .filter("letter <> ''")
        .select(
            F.element_at(F.array(*[F.lit(s) for s in ("ricardone", "san_lorenzo", "avellaneda")]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("site_id"),
            F.when(key % 9 != 0, F.concat(F.lit("v"), key)).alias("visit_id"),
            F.concat(F.lit("P"), F.col("o_custkey")).alias("plate"),
            F.concat(F.lit("D"), key).alias("doc_number"),
            (start + F.col("step").cast("long") * 300_000_000).alias("at_us"),
            pick(EVENT_OF, "letter").alias("event_type"),
            F.when((F.col("letter") == "C") & (F.col("step") == last_c), final).when(F.col("letter") == "C", "OBS").alias("lab_result"),
            (key * 100 + F.col("step")).alias("row_no"),
        )
    )


def full_gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a result of the laboratory a minute after each sample, a start two minutes before each discharge end, and
    whole hours instead of instants for some visits, so that their events tie."""
    base = gate_events(spark, sf_dir)
    lab = base.filter("lab_result is not null").select(*[c for c in base.columns if c not in ("event_type", "at_us", "row_no")], F.lit("LAB_RESULT_READY").alias("event_type"), (F.col("at_us") + 60_000_000).alias("at_us"), (F.col("row_no") + 30).alias("row_no"))
    start = base.filter("event_type = 'DISCHARGE_END'").select(*[c for c in base.columns if c not in ("event_type", "at_us", "row_no")], F.lit("unload start").alias("event_type"), (F.col("at_us") - 120_000_000).alias("at_us"), (F.col("row_no") + 60).alias("row_no"))
    rows = base.withColumn("lab_result", F.lit(None).cast("string")).unionByName(lab).unionByName(start)
    tied = F.expr("row_no div 100 % 5 = 0")
    return rows.withColumn("at_us", F.when(tied, F.expr("at_us div 3600000000 * 3600000000")).otherwise(F.col("at_us")))


def camera_events(trips_df: DataFrame) -> DataFrame:
    """One read per sector of a trip at even times; some trips lose S4, repeat a sector, or stop early."""
    n = F.col("event_id")
    seq = (
        F.when(n % 17 == 3, F.filter("sectors", lambda s: s != "S4"))
        .when(n % 17 == 5, F.flatten(F.transform("sectors", lambda s: F.when(s == "S4", F.array(s, s)).otherwise(F.array(s)))))
        .when(n % 17 == 7, F.slice("sectors", 1, 2))
        .otherwise(F.col("sectors"))
    )
    return (
        trips_df.withColumn("seq", seq)
        .select("trip_id", "truck_id", "plate", "site_id", "circuit", "in_us", "out_us", F.size("seq").alias("n"), F.posexplode("seq").alias("step", "sector"))
        .withColumn("at_us", F.col("in_us") + F.expr("(out_us - in_us) * step div n"))
        .withColumn("camera_id", F.concat(F.lit("CAM_"), F.col("sector")))
        .drop("n")
    )


#: Plants in the order in which their files are read, and events whose rows share a file.
PLANT_ORDER, FILE_EVENTS = ["ricardone", "san_lorenzo", "avellaneda"], 4096


def _envelopes(rows: DataFrame, payload: str, generated: bool = True) -> DataFrame:
    """(part, ordinal, json): envelopes of rows (site_id, day, event_id, step, record). A day of a plant is cut into files by event
    id, so that no row holds more than the rows of so many events, in order."""
    rows = rows.withColumn("chunk", F.expr(f"event_id div {FILE_EVENTS}"))
    packed = rows.groupBy("site_id", "day", "chunk").agg(F.sort_array(F.collect_list(F.struct("event_id", "step", "record")))["record"].alias(payload))
    at = F.when(F.col("day") % 2 == 0, F.concat(F.lit("at "), F.col("day").cast("string"))).otherwise("") if generated else F.lit("")
    doc = F.struct(F.lit("1.0").alias("version"), at.alias("generatedAt"), F.col("site_id").alias("planta"), payload)
    part = F.array_position(F.array(*map(F.lit, PLANT_ORDER)), F.col("site_id")).cast("int")
    return packed.select(part.alias("part"), F.concat(F.lpad(F.col("day").cast("string"), 8, "0"), F.lpad(F.col("chunk").cast("string"), 12, "0")).alias("ordinal"), F.to_json(doc).alias("json"))


def iso(us: str):
    """An instant as text in UTC, whatever the session's zone."""
    s = F.floor(F.pmod(F.col(us), F.lit(86_400_000_000)) / 1_000_000).cast("long")
    clock = F.format_string("T%02d:%02d:%02d.%06dZ", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.pmod(F.col(us), F.lit(1_000_000)))
    return F.concat(F.date_format(date_of(F.col(us)), "yyyy-MM-dd"), clock)


def _day(us: str):
    return F.floor(F.col(us) / 86_400_000_000).alias("day")


def trip_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as JSON envelopes of their history files; some lack an id, a truck, a plate, a code or a class."""
    n = F.col("event_id")
    record = F.struct(
        F.when(n % 5 != 1, F.col("trip_id")).alias("tripId"), F.when(n % 7 != 2, F.concat(F.lit("T"), "truck_id")).alias("truckId"), F.when(n % 11 != 3, F.col("plate")).alias("plate"),
        F.concat(F.lit(" "), F.initcap(F.replace("site_id", F.lit("_"), F.lit(" ")))).alias("plant"),
        F.when(n % 6 != 0, F.col("circuit")).alias("inferredCircuitCode"), F.when(n % 12 != 0, F.lit("ALT")).alias("circuitCode"), iso("in_us").alias("startedAt"), iso("out_us").alias("endedAt"), F.col("sectors").alias("visitedSectors"),
        (n % 2 == 0).alias("completed"), F.floor("duration_minutes").alias("durationMinutes"), F.when(n % 3 == 0, F.col("state")).alias("classification"), F.when(n % 13 == 0, F.lit("2024-01-05")).alias("fecha"),
    )
    return _envelopes(trips(spark, sf_dir).select("site_id", _day("in_us"), "event_id", F.lit(0).alias("step"), record.alias("record")), "data")


def alert_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON envelopes; severities and states of any spelling, some without an id, a type, a truck or a sector of their own."""
    n = F.col("event_id")
    record = F.struct(
        F.when(n % 5 != 1, F.col("alert_id")).alias("alertId"), F.when(n % 10 != 4, F.col("alert_type")).alias("type"), F.when(n % 8 != 0, F.lower("severity")).otherwise("severe").alias("severity"), F.initcap("status").alias("status"), F.upper("site_id").alias("plant"),
        F.when(n % 3 == 0, F.concat(F.lit("T"), "truck_id")).alias("truckId"), iso("at_us").alias("detectedAt"), F.when(n % 2 == 0, F.col("sector")).alias("sectorId"), F.struct(F.lit("S8").alias("sector"), F.lit("S9").alias("currentSector"), F.lit("S7").alias("expectedEnd")).alias("context"),
    )
    return _envelopes(alerts(spark, sf_dir).select("site_id", _day("at_us"), "event_id", F.lit(0).alias("step"), record.alias("record")), "data")


def read_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera reads as JSON envelopes under ``events``; some lack an id, a plate, a camera or a truck."""
    record = F.struct(
        F.when(F.col("step") != 3, F.concat("trip_id", F.lit("/"), "step")).alias("eventId"), F.lit("anpr").alias("eventType"), iso("at_us").alias("snapshotTime"), F.when(F.col("step") != 2, F.col("plate")).alias("plateNo"), F.col("site_id").alias("plant"),
        F.when(F.col("step") != 1, F.col("camera_id")).alias("cameraId"), F.col("sector").alias("sector"), F.when(F.col("step") != 4, F.col("trip_id")).alias("inferredTruckId"), F.col("circuit").alias("inferredCircuitCode"),
    )
    reads = camera_events(trips(spark, sf_dir)).withColumn("event_id", F.replace("trip_id", F.lit("trip-"), F.lit("")).cast("long"))
    return _envelopes(reads.select("site_id", _day("at_us"), "event_id", "step", record.alias("record")), "events")
