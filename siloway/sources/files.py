"""JSON envelopes, CSV samples and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.functions.scalar import date_of, severity_of, site_of, status_of
from siloway.operators.positions import running_index

PLANTS = ["ricardone", "san_lorenzo", "avellaneda"]

RAW = "eventType string, snapshotTime string, plateNo string, region string, targetPlateSize string, logo string, vehicleType string"
ENRICHED = RAW + ", eventId string, plant string, cameraId string, sector string, inferredTruckId string, inferredCircuitCode string, source string, imageUrl string"
ACTIVE = "truckId string, plate string, plant string, circuitCode string, currentSector string, currentCameraId string, lastSeenAt string, visitedSectors array<string>, eventCount long"
HISTORY = (
    "tripId string, truckId string, plate string, plant string, inferredCircuitCode string, circuitCode string, startedAt string, endedAt string, visitedSectors array<string>, "
    "expectedSequence array<string>, completed boolean, durationMinutes long, classification string, fecha string, catalogCode string, catalogName string, cir string, vue string, descripcion string, productType string"
)
ALERTS = (
    "alertId string, type string, severity string, status string, plant string, truckId string, plate string, message string, detectedAt string, sectorId string, cameraCode string, "
    "circuitoEsperado string, circuitoObservado string, context struct<sector:string,expectedEnd:string,expectedCircuit:string,currentSector:string,minutesWithoutSignal:long>"
)


def _schema(rows: str) -> str:
    return f"version string, generatedAt string, scenario string, planta string, events array<struct<{_fields(rows)}>>, data array<struct<{_fields(rows)}>>"


def envelope(spark: SparkSession, paths: list[str], rows: str) -> DataFrame:
    """The rows of JSON envelopes, whose payload is ``events`` or ``data``, numbered through all files in the order of ``paths``;
    missing files are skipped, none gives no rows."""
    reader = spark.read.schema(_schema(rows)).option("multiLine", True)
    made = spark.createDataFrame([], "part int, ordinal string, " + _schema(rows))
    for i, path in enumerate(paths):
        if _exists(spark, path):
            made = made.unionByName(reader.json(path).select(F.lit(i).alias("part"), F.col("_metadata.file_path").alias("ordinal"), "*"))
    return _payload(made, rows)


def unpacked(texts: DataFrame, rows: str) -> DataFrame:
    """The rows of envelopes that are texts: (part, ordinal, json), the part being a plant's number and the ordinal the order of
    its texts. Rows are numbered through all of them; a text that is no envelope gives none."""
    return _payload(texts.select("part", "ordinal", F.from_json("json", _schema(rows)).alias("d")).select("part", "ordinal", "d.*"), rows)


def _payload(docs: DataFrame, rows: str) -> DataFrame:
    """(generatedAt, envelope_plant, row_no, fields): ``row_no`` counts from 0 over all envelopes, so a default id that is made of it
    is unique among all plants."""
    payload = F.coalesce("events", "data", F.expr(f"cast(array() as array<struct<{_fields(rows)}>>)"))
    each = docs.select("part", "ordinal", "generatedAt", F.col("planta").alias("envelope_plant"), F.posexplode(payload).alias("_within", "r"))
    return running_index(each, "part", "ordinal", "_within", "row_no").select("generatedAt", "envelope_plant", "row_no", "r.*")


def generated_at(texts: DataFrame) -> DataFrame:
    """(generated_at): when envelopes (part, ordinal, json) were made, the last in order that says so."""
    said = texts.select("part", "ordinal", F.get_json_object("json", "$.generatedAt").alias("at")).filter("at <> ''")
    return said.agg(F.max_by("at", F.struct("part", "ordinal")).alias("generated_at"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in _split(ddl)))


def _split(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find a path; nothing of the file is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return False
        raise
    return True


def by_plant(base: str, scenario: str, name: str) -> list[str]:
    """The files of a table: one per plant for live and march scenarios, else one."""
    if scenario == "live" or scenario.startswith("march_full"):
        return [f"{base}/{scenario}/{p}/{name}" for p in PLANTS]
    return [f"{base}/{scenario}/{name}"]


def _instant(c: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(c))


def _numbered(name: str, begin: str) -> Column:
    """A field, or where it is missing its row's number in the whole input after ``begin``."""
    return F.coalesce(F.col(name), F.concat(F.lit(begin), F.col("row_no")))


def enriched_events(rows: DataFrame, site: str | None = None) -> DataFrame:
    out = rows.select(
        _numbered("eventId", "enr-").alias("event_id"), _instant("snapshotTime").alias("at_us"), F.coalesce("cameraId", F.lit("CAM_UNKNOWN")).alias("camera_id"),
        F.coalesce("sector", F.lit("S?")).alias("sector"), _numbered("inferredTruckId", "truck-").alias("truck_id"), F.coalesce("plateNo", F.lit("N/A")).alias("plate"),
        F.lit(0.9).alias("confidence"), site_of(F.col("plant")).alias("site_id"), F.col("inferredCircuitCode").alias("circuit"),
    )
    return out if site is None else out.filter(F.col("site_id") == site)


def historical_trips(rows: DataFrame, now_us: int | None = None) -> DataFrame:
    """Trips of history envelopes with the defaults of missing fields: numbered ids, ``N/A`` for plate and circuit, ``now_us`` for
    instants, the day of exit for ``fecha``. Nothing stands in for the inferred circuit."""
    state = F.coalesce("classification", F.when(F.col("completed"), "VALIDADO").otherwise("CON_OBSERVACIONES"))
    now = F.lit(now_us).cast("long")
    out = rows.select(
        _numbered("tripId", "trip-").alias("trip_id"), _numbered("truckId", "truck-").alias("truck_id"), F.coalesce("plate", F.lit("N/A")).alias("plate"), site_of(F.col("plant")).alias("site_id"),
        F.coalesce("inferredCircuitCode", F.lit("N/A")).alias("circuit"), F.col("catalogCode").alias("catalog_code"), F.coalesce(_instant("startedAt"), now).alias("in_us"), F.coalesce(_instant("endedAt"), now).alias("out_us"),
        F.coalesce("durationMinutes", F.lit(0)).cast("double").alias("duration_minutes"), F.coalesce("visitedSectors", F.expr("cast(array() as array<string>)")).alias("sectors"),
        F.transform("expectedSequence", lambda s: F.concat(F.lit("CAM_"), s)).alias("cameras"), state.alias("state"), F.col("productType").alias("product_type"), F.col("fecha").try_cast("date").alias("_day"),
    )
    return out.withColumn("trip_date", F.coalesce("_day", date_of(F.col("out_us")))).drop("_day")


def operational_alerts(rows: DataFrame, now_us: int) -> DataFrame:
    """Alerts of envelopes with the defaults of missing fields; the sector is the alert's own, else the one of its context."""
    at = F.coalesce(_instant("detectedAt"), F.lit(now_us))
    return rows.select(
        _numbered("alertId", "alert-").alias("alert_id"), F.coalesce("type", F.lit("SIN_ACTUALIZACION")).alias("alert_type"), severity_of(F.col("severity")).alias("severity"), status_of(F.col("status")).alias("status"),
        site_of(F.col("plant")).alias("site_id"), _numbered("truckId", "truck-").alias("truck_id"), F.coalesce("plate", F.lit("N/A")).alias("plate"), F.coalesce("sectorId", "context.currentSector").alias("sector"), at.alias("at_us"),
        F.greatest(F.lit(0), F.floor((F.lit(now_us) - at) / 60_000_000)).alias("elapsed_minutes"), F.coalesce("circuitoEsperado", "context.expectedEnd").alias("expected"),
        F.coalesce("circuitoObservado", "context.currentSector").alias("observed"), F.col("cameraCode").alias("camera_id"), F.col("message").alias("note"),
    )


@dataclass(frozen=True)
class Config:
    """Where a scenario's files lie; ``replace`` gives another scenario of the same place."""

    base: str = "/mock-data"
    scenario: str = "march_full"

    def tables(self, spark: SparkSession, now_us: int = 0) -> dict[str, DataFrame]:
        return load(spark, self.base, self.scenario, now_us)


#: Trips under which the ``normal`` scenario takes its history from ``march_full``, if that is larger (fixed value).
FEW_TRIPS = 500


def load(spark: SparkSession, base: str, scenario: str = "march_full", now_us: int = 0) -> dict[str, DataFrame]:
    """All tables of a scenario by name; a missing table is empty. The ``live`` scenario takes its history from ``march_full``
    while it has none of its own, the ``normal`` one while it has few trips and the other has more."""
    tables = _load(spark, base, scenario, now_us)
    if scenario in ("live", "normal"):
        few = FEW_TRIPS if scenario == "normal" else 1
        own = tables["trips"].limit(few).count()
        if own < few:
            other = _load(spark, base, "march_full", now_us)["trips"]
            if other.limit(own + 1).count() > own:
                tables["trips"] = other
    return tables


def _load(spark: SparkSession, base: str, scenario: str, now_us: int) -> dict[str, DataFrame]:
    def read(name: str, rows: str) -> DataFrame:
        return envelope(spark, by_plant(base, scenario, name), rows)

    return {
        "raw_events": read("raw_camera_events.json", RAW), "events": enriched_events(read("camera_events_enriched.json", ENRICHED)), "active": read("camiones_en_planta.json", ACTIVE),
        "trips": historical_trips(read("historico_recorridos.json", HISTORY), now_us), "alerts": operational_alerts(read("alertas_operativas.json", ALERTS), now_us),
    }


#: Columns of raw event rows and the other names they come under, in order (fixed values).
EVENT_ALIASES = {
    "site_id": ["siteId"], "visit_id": ["visitId"], "plate": ["plate"], "doc_number": ["docNumber"], "product": ["product"], "occurred_at": ["occurredAt", "timestamp"], "event_type": ["eventType", "event"],
    "location": ["locationKey", "location"], "weight_kg": ["weightKg", "pesoBruto", "pesoNeto"], "moisture": ["moisture", "humedad"], "lab_result": ["labResult", "resultado", "status"],
    "unload_point": ["unloadPoint", "pit", "bay"], "unload_qty": ["unloadQty", "measuredQty"],
}


def raw_event_rows(rows: DataFrame) -> DataFrame:
    """Rows of any spelling under the domain's names; blank is null, numbers that do not parse are null, rows without time or type go."""
    have = {c.lower(): c for c in rows.columns}

    def first(names: list[str]) -> Column:
        found = [F.nullif(F.trim(F.col(have[n.lower()]).cast("string")), F.lit("")) for n in names if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = rows.select(*[first(names).alias(c) for c, names in EVENT_ALIASES.items()])
    for c in ("weight_kg", "moisture", "unload_qty"):
        out = out.withColumn(c, F.col(c).try_cast("double"))
    out = out.filter("occurred_at is not null and event_type is not null").withColumn("site_id", F.coalesce("site_id", F.lit("default")))
    return out.withColumn("at_us", _instant("occurred_at"))


def csv_samples(spark: SparkSession, path: str) -> DataFrame:
    return raw_event_rows(spark.read.option("header", True).csv(path))


def write_partitioned(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header each; commas, quotes and newlines are quoted, null is empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


#: What precedes the rows of an exported table: name of the part and how its line begins (fixed values).
META = [("title", "# "), ("subtitle", "# "), ("plant", "# Planta: "), ("period", "# Período: "), ("generated", "# Generado: ")]


def csv_lines(df: DataFrame, meta: dict[str, str] | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
    """(part, line) of an exported table: lines of the meta data (part 0), the header (1) and the rows (2).

    A value with a comma, a quote or a newline is quoted, quotes doubled; null is empty. Sorted by part, the lines are the file;
    with ``keys``, columns of the rows by name, there are also they and ``place``, the order of lines within the first parts.
    """
    lines = [(0, i, f"{begin}{meta[name]}") for i, (name, begin) in enumerate(META) if meta and meta.get(name)]
    head = df.sparkSession.createDataFrame([*lines, (1, 0, ",".join(df.columns))], "part int, place int, line string")

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    rows = df.select(F.lit(2).alias("part"), F.lit(0).alias("place"), F.concat_ws(",", *map(cell, df.columns)).alias("line"), *[c.alias(k) for k, c in (keys or {}).items()])
    both = head.unionByName(rows, allowMissingColumns=True)
    return both if keys is not None else both.drop("place")
