"""Visits out of raw gate events: visit keys, path strings, validation, story, status, metrics, and what charts select.

One shuffle by visit key gathers a visit's few events into a sorted array; everything after is array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.dims import PATHS_WITH_DISCHARGE, PATHS_WITHOUT_DISCHARGE, STEP_ORDER
from siloway.functions.scalar import DAY_US, HOUR_US, MINUTE_US, bucket_status, cargo_form, path_key, round_half_up

#: Event names other than the domain's own, and the domain's (fixed values).
ALIASES = {"UNLOAD_START": "DISCHARGE_START", "UNLOAD_END": "DISCHARGE_END", "GATE_CHECKOUT": "EXIT", "SAMPLE_RESULT": "LAB_RESULT_READY", "WAIT": "YARD_WAIT", "QUEUE_WAIT": "YARD_WAIT"}
NAMES = (
    "GATE_CHECKIN SCALE_IN SAMPLE_SOLID_TAKEN SAMPLE_LIQUID_TAKEN LAB_RESULT_READY DISCHARGE_ASSIGNED DISCHARGE_START DISCHARGE_END SCALE_OUT EXIT YARD_WAIT QUEUE_OUTSIDE".split()
)
LETTERS = {"GATE_CHECKIN": "A", "SCALE_IN": "B", "SAMPLE_SOLID_TAKEN": "C", "SAMPLE_LIQUID_TAKEN": "C", "DISCHARGE_END": "D", "SCALE_OUT": "E", "EXIT": "F", "YARD_WAIT": "G"}
MAX_C, MAX_D = 3, 2
STORY = {
    "GATE_CHECKIN": "Ingreso", "SCALE_IN": "Pesaje entrada", "SAMPLE_SOLID_TAKEN": "Calada", "SAMPLE_LIQUID_TAKEN": "Calada", "LAB_RESULT_READY": "Lab", "DISCHARGE_START": "Inicio descarga",
    "DISCHARGE_END": "Fin descarga", "SCALE_OUT": "Pesaje salida", "EXIT": "Egreso", "YARD_WAIT": "Espera",
}


def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def event_name(raw: Column) -> Column:
    up = F.regexp_replace(F.upper(F.trim(raw)), "\\s+", "_")
    return F.coalesce(_map(ALIASES, up), F.when(up.isin(NAMES), up), F.lit("UNKNOWN"))


def lab_result(raw: Column) -> Column:
    """NO, OBS or OK of any spelling; rejection before observation before approval."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("no", "rechazado", "rejected"), "NO").when(low.isin("obs", "observado", "observed"), "OBS").when(low.isin("ok", "si", "aprobado", "approved"), "OK")


def bucket_label(us: Column, hours: int) -> Column:
    """The start of the bucket of so many hours that an instant is in, as yyyy-MM-ddTHH."""
    start = us - F.pmod(us, F.lit(hours * HOUR_US))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(start / F.lit(DAY_US)).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(F.floor(F.pmod(start, F.lit(DAY_US)) / F.lit(HOUR_US)).cast("string"), 2, "0"))


def with_visit_key(events: DataFrame, fallback_hours: int = 2) -> DataFrame:
    """Adds ``visit_key`` and ``key_fallback``: site, visit id and half day, or site, plate, document and a shorter bucket."""
    has = F.coalesce(F.trim("visit_id"), F.lit("")) != ""

    def known(c: str) -> Column:
        return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("NONE"))

    own = F.concat_ws("|", "site_id", F.trim("visit_id"), bucket_label(F.col("at_us"), 12))
    other = F.concat_ws("|", F.col("site_id"), known("plate"), known("doc_number"), bucket_label(F.col("at_us"), fallback_hours))
    return events.withColumn("visit_key", F.when(has, own).otherwise(other)).withColumn("key_fallback", ~has)


def step_order(event: Column) -> Column:
    """The place of an event in a visit's logical order; 99 for events that have none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STEP_ORDER.items() for x in kv]), event), F.lit(99))


def normalised(events: DataFrame) -> DataFrame:
    """Raw gate events with the domain's event name, laboratory result and cargo form (UNKNOWN where none is given)."""
    form = cargo_form(F.col("cargo_form")) if "cargo_form" in events.columns else F.lit("UNKNOWN")
    return events.withColumn("event", event_name(F.col("event_type"))).withColumn("result", lab_result(F.col("lab_result"))).withColumn("cargo_form", form)


def visits(events: DataFrame, fallback_hours: int = 2, ties: str = "name", within: tuple[Column, ...] = ()) -> DataFrame:
    """One row per visit: its keys and its events sorted by time; events of one instant by name, or by logical ``step``.

    Keys are those of the visit's first input row where the events carry ``row_no``, else the least. ``within`` are further
    columns to group by that follow from the key: a stream's window, which the watermark closes.
    """
    keyed = with_visit_key(normalised(events), fallback_hours)
    ordinal = (step_order(F.col("event")) if ties == "step" else F.lit(0)).alias("ordinal")

    def first(c: str) -> Column:
        return (F.min_by(c, "row_no") if "row_no" in events.columns else F.min(c)).alias(c)

    row = F.col("row_no") if "row_no" in events.columns and ties == "step" else F.lit(0)
    place = F.upper(F.trim("location")) if "location" in events.columns else F.lit(None).cast("string")
    return keyed.groupBy(*within, "visit_key").agg(
        first("site_id"), first("visit_id"), first("plate"), first("doc_number"), F.bool_or("key_fallback").alias("key_fallback"),
        F.sort_array(F.collect_list(F.struct("at_us", ordinal, row.alias("row"), "event", "result", "cargo_form", place.alias("location"), _map(LETTERS, F.col("event")).alias("letter")))).alias("events"),
    )


def with_path(visit: DataFrame) -> DataFrame:
    """Adds ``path`` (at most three C and two D are kept), ``results`` in event order, and ``last_result`` of the last C.

    Results are matched to the C's by position, so a last C without a result of its own has none.
    """

    def capped(letters: Column, letter: str, most: int) -> Column:
        """Letters without those of one kind after its ``most``-th."""
        parts = f"^((?:[^{letter}]*{letter}){{{most}}})(.*)$"
        head, tail = F.regexp_extract(letters, parts, 1), F.regexp_extract(letters, parts, 2)
        return F.when(head != "", F.concat(head, F.translate(tail, letter, ""))).otherwise(letters)

    letters = F.array_join(F.col("events")["letter"], "")  # events without a letter are passed over
    samples = F.filter("events", lambda e: e["event"].isin("SAMPLE_SOLID_TAKEN", "SAMPLE_LIQUID_TAKEN", "LAB_RESULT_READY") & e["result"].isNotNull())
    n_c = F.length("path") - F.length(F.translate("path", "C", ""))
    return (
        visit.withColumn("path", capped(capped(letters, "C", MAX_C), "D", MAX_D))
        .withColumn("results", F.transform(samples, lambda e: e["result"]))
        .withColumn("last_result", F.when(n_c > 0, F.get("results", n_c - 1)))
    )


def validated(visit: DataFrame) -> DataFrame:
    """Adds ``flags`` in order of the rules, ``status``, ``path_display`` and ``explanation``."""
    path, last = F.col("path"), F.col("last_result")
    has_b, has_c, has_d = (path.contains(x) for x in "BCD")

    def events_named(name: str) -> Column:
        return F.size(F.filter("events", lambda e: e["event"] == name))

    repeated = (events_named("SCALE_IN") > 1) | (events_named("SCALE_OUT") > 1) | (events_named("EXIT") > 1)
    rules = [
        (~path.startswith("A"), "MISSING_EVENT"),
        (~has_b & (has_c | has_d | path.contains("E")), "MISSING_EVENT"),
        (~has_c, "MISSING_EVENT"),
        (~path.endswith("F"), "OPEN_TRIP"),
        (has_d & ~last.eqNullSafe("OK"), "D_WITHOUT_OK"),
        (~has_d & last.eqNullSafe("OK"), "D_WITHOUT_OK"),
        (~path.isin(PATHS_WITH_DISCHARGE + PATHS_WITHOUT_DISCHARGE), "INVALID_PATH"),
        (has_d & last.isNull(), "NO_CALADA_RESULT"),
        (path.rlike("D.*G.*E") | path.rlike("G.*G.*G"), "WAIT_SUSPICIOUS"),
        (repeated, "DUPLICATE_EVENT"),
    ]
    flags = F.filter(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]), lambda f: f.isNotNull())
    flags = F.when(path == "", F.array(F.lit("MISSING_EVENT"))).otherwise(flags)
    status = F.when(F.size("flags") > 0, "INVALID").when(path == "ABCDEF", "VALID_IDEAL").when(has_d, "VALID_ACCEPTABLE").otherwise("VALID_NO_DISCHARGE")
    display = F.array_join(F.filter(F.split(path, ""), lambda c: c != ""), "-")
    said = (
        F.when(path == "", "No se pudo construir secuencia del circuito (ningún evento mapeable a A..G).")
        .when(F.col("status") == "INVALID", F.concat(F.lit("Recorrido inválido: "), F.array_join("flags", ", "), F.lit(". Secuencia: "), display, F.lit(".")))
        .when(F.col("status") == "VALID_IDEAL", F.concat(F.lit("Recorrido ideal sin esperas. Secuencia: "), display, F.lit(".")))
        .when(F.col("status") == "VALID_ACCEPTABLE", F.concat(F.lit("Recorrido aceptable (con espera y/o re-calada). Secuencia: "), display, F.lit(".")))
        .otherwise(F.concat(F.lit("Recorrido sin descarga (calada NO). Secuencia: "), display, F.lit(".")))
    )
    return visit.withColumn("flags", flags).withColumn("status", status).withColumn("path_display", display).withColumn("explanation", said)


def once(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns held in the one row of an explode, so that a filter on them does not work them out again."""
    held = df.withColumn("_once", F.explode(F.array(F.struct(*columns)))).drop(*columns)
    return held.select(*[c for c in held.columns if c != "_once"], "_once.*")


def trips_of(events: DataFrame) -> DataFrame:
    """Validated visits; the flag of a fallback key is added after the status is set."""
    return trips_of_visits(visits(events))


def trips_of_visits(gathered: DataFrame) -> DataFrame:
    """Visits, of a table or a stream, with path, results, flags and status."""
    found = once(with_path(gathered), ["path", "results", "last_result"])
    out = once(validated(found), ["flags", "status", "path_display", "explanation"])
    return out.withColumn("flags", F.when(F.col("key_fallback"), F.concat("flags", F.array(F.lit("VISIT_KEY_FALLBACK_USED")))).otherwise(F.col("flags")))


def clock(us: Column) -> Column:
    s = F.floor(F.pmod(us, F.lit(DAY_US)) / F.lit(1_000_000)).cast("int")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def with_story(visit: DataFrame) -> DataFrame:
    """Adds ``story``: each event's name and time in order; a discharge end tells the minutes since its latest open start."""

    def tell(acc: Column, e: Column) -> Column:
        minutes = F.floor((e["at_us"] - acc["open"]) / F.lit(MINUTE_US) + 0.5).cast("long")
        told = F.concat(F.coalesce(_map(STORY, e["event"]), e["event"]), F.lit(" "), clock(e["at_us"]))
        lab = F.when((e["event"] == "LAB_RESULT_READY") & e["result"].isNotNull(), F.concat(F.lit(" ("), e["result"], F.lit(")"))).otherwise("")
        length = F.when((e["event"] == "DISCHARGE_END") & acc["open"].isNotNull(), F.concat(F.lit(" Duración "), minutes.cast("string"), F.lit(" min"))).otherwise("")
        opened = F.when(e["event"] == "DISCHARGE_START", e["at_us"]).when(e["event"] != "DISCHARGE_END", acc["open"])
        return F.struct(F.concat(acc["parts"], F.array(F.concat(told, lab, length))).alias("parts"), opened.alias("open"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(None).cast("long").alias("open"))
    told = F.array_join(F.aggregate("events", start, tell)["parts"], " -> ")
    return visit.withColumn("story", F.when(F.size("events") == 0, "Sin eventos.").otherwise(told))


def first_at(name: str) -> Column:
    """When a visit's first event of a name was; null without one."""
    names = ("SAMPLE_SOLID_TAKEN", "SAMPLE_LIQUID_TAKEN") if name == "SAMPLE" else (name,)
    return F.get(F.filter("events", lambda e: e["event"].isin(*names)), F.lit(0))["at_us"]


def minutes_between(a: Column, b: Column) -> Column:
    return round_half_up((b - a) / F.lit(MINUTE_US))


def with_metrics(visit: DataFrame) -> DataFrame:
    """Adds visit status, cycle, gate to sample, sample to lab, discharge and yard-wait minutes, and missing steps."""
    start, end = F.get("events", F.lit(0))["at_us"], F.element_at("events", -1)["at_us"]
    exited, ended = first_at("EXIT").isNotNull(), first_at("DISCHARGE_END").isNotNull()
    rejected = F.exists("events", lambda e: (e["event"] == "LAB_RESULT_READY") & (e["result"] == "NO"))
    cycle = minutes_between(start, end)
    waits = F.filter("events", lambda e: e["event"] == "YARD_WAIT")
    assigned = minutes_between(first_at("LAB_RESULT_READY"), first_at("DISCHARGE_ASSIGNED"))
    yard = F.when(F.size(waits) >= 2, minutes_between(F.get(waits, F.lit(0))["at_us"], F.element_at(waits, -1)["at_us"])).when(first_at("DISCHARGE_ASSIGNED") > first_at("LAB_RESULT_READY"), assigned)
    solid = first_at("SAMPLE_SOLID_TAKEN")
    missing = F.array(F.when(solid.isNull() & ended, "SAMPLE_SOLID_TAKEN"), F.when(first_at("SCALE_OUT").isNotNull() & first_at("SCALE_IN").isNull(), "SCALE_IN"))
    return visit.withColumns(
        {
            "visit_status": F.when(rejected & exited & ~ended, "REJECTED").when(exited, "CLOSED").otherwise("OPEN"),
            "cycle_minutes": F.when(exited, F.greatest(F.lit(1), cycle)).otherwise(cycle),
            "to_sample_minutes": minutes_between(first_at("GATE_CHECKIN"), first_at("SAMPLE")),
            "lab_minutes": minutes_between(first_at("SAMPLE"), first_at("LAB_RESULT_READY")),
            "discharge_minutes": minutes_between(first_at("DISCHARGE_START"), first_at("DISCHARGE_END")),
            "yard_minutes": yard,
            "missing_steps": F.filter(missing, lambda m: m.isNotNull()),
        }
    )


def scatter(trips: DataFrame) -> DataFrame:
    """Closed valid visits with a check-in: minute of day of arrival and minutes of stay, 1 at least."""
    a, f = first_at("GATE_CHECKIN"), first_at("EXIT")
    rows = trips.withColumn("bucket", bucket_status(F.col("status"))).filter(a.isNotNull() & f.isNotNull() & F.col("bucket").isin("PERFECT", "VALID"))
    entry = F.floor(F.pmod(a, F.lit(DAY_US)) / F.lit(MINUTE_US)).cast("int")
    return rows.select("visit_key", "site_id", "plate", entry.alias("entry_minute"), F.greatest(F.lit(1), minutes_between(a, f)).alias("stay_minutes"), "bucket", path_key(F.col("path")).alias("path_key"))


def scatter_stats(points: DataFrame) -> DataFrame:
    """Median, 95th percentile and number of stays. Stays are whole minutes, so the percentiles' buffer holds few distinct values."""
    return points.agg(F.percentile("stay_minutes", F.lit(0.5)).alias("p50"), F.percentile("stay_minutes", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))


def pie(trips: DataFrame) -> DataFrame:
    """Closed visits by bucket, always three rows."""
    found = trips.filter(first_at("EXIT").isNotNull()).groupBy(bucket_status(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("visits"))
    spine = trips.sparkSession.createDataFrame([("PERFECT",), ("VALID",), ("INVALID",)], "bucket string")
    return spine.join(F.broadcast(found), "bucket", "left").fillna(0, ["visits"])


def path_bars(trips: DataFrame) -> DataFrame:
    return trips.filter("status <> 'INVALID'").groupBy(path_key(F.col("path")).alias("path_key")).agg(F.count(F.lit(1)).alias("visits"))


def of_bucket(trips: DataFrame, bucket: str | None) -> DataFrame:
    return trips if bucket is None else trips.filter(bucket_status(F.col("status")) == bucket)


def visit_results(trips: DataFrame) -> DataFrame:
    """Validated visits as reconstructed ones: (visit_id, site_id, plate, visit_status, cargo_form, start_us, end_us, cycle_minutes).

    Invalid visits are REJECTED, all others CLOSED; a visit without an id is named by its key, and a cycle with an exit lasts a
    minute at least; a single event has none.
    """
    first, last = F.get("events", F.lit(0)), F.element_at("events", -1)
    minutes = minutes_between(first["at_us"], last["at_us"])
    cycle = F.when(F.exists("events", lambda e: e["event"] == "EXIT"), F.greatest(F.lit(1), minutes)).otherwise(minutes)
    return trips.select(
        F.coalesce(F.when(F.trim("visit_id") != "", F.trim("visit_id")), F.col("visit_key")).alias("visit_id"), "visit_key", "site_id", "plate", F.when(F.col("status") == "INVALID", "REJECTED").otherwise("CLOSED").alias("visit_status"),
        first["cargo_form"].alias("cargo_form"), first["at_us"].alias("start_us"), last["at_us"].alias("end_us"), F.when(F.size("events") >= 2, cycle).alias("cycle_minutes"),
    )


#: Nodes of the route view by event, and by place for events that give none (fixed values). Bays of liquids are D, whatever their number.
NODES = LETTERS | {"QUEUE_OUTSIDE": "A", "DISCHARGE_ASSIGNED": "D", "DISCHARGE_START": "D"}
PLACES = {"GATE": "A", "SCALE_IN": "B", "SAMPLE_BAY_A": "C", "SAMPLE_BAY_B": "C", "YARD_A": "G", "YARD_B": "G", "PIT_1": "D", "PIT_2": "D", "PIT_3": "D", "SCALE_OUT": "E", "EXIT": "F"}


def node_of(event: Column, location: Column) -> Column:
    """The node of an event, else of its place; results of the laboratory are no node."""
    placed = F.coalesce(_map(PLACES, location), F.when(location.startswith("LIQUID_BAY"), "D"))
    return F.coalesce(_map(NODES, event), F.when(event != "LAB_RESULT_READY", placed))


def sim_nodes(visit: DataFrame) -> DataFrame:
    """(visit_key, ordinal, node): the visit's nodes without immediate repeats, for the route view."""
    return sim_nodes_with_results(visit).select("visit_key", "ordinal", "node")


def sim_nodes_with_results(visit: DataFrame) -> DataFrame:
    """(visit_key, ordinal, node, event_no, result): nodes without immediate repeats; a laboratory result goes to the latest C."""
    rows = visit.select("visit_key", F.posexplode("events").alias("event_no", "e")).select("visit_key", "event_no", node_of(F.col("e.event"), F.col("e.location")).alias("node"), F.col("e.event").alias("event"), F.col("e.result").alias("result"))
    order = Window.partitionBy("visit_key").orderBy("event_no")  # a visit has a handful of events
    steps = rows.withColumn("before", F.last("node", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = steps.withColumn("fresh", F.col("node").isNotNull() & ~F.col("node").eqNullSafe(F.col("before")))
    numbered = fresh.withColumn("ordinal", F.count_if("fresh").over(order) - 1).withColumn("latest_c", F.max(F.when(F.col("fresh") & (F.col("node") == "C"), F.col("ordinal"))).over(order))
    lab = numbered.filter("event = 'LAB_RESULT_READY' and result is not null and latest_c is not null").groupBy("visit_key", F.col("latest_c").alias("ordinal")).agg(F.max_by("result", "event_no").alias("result"))
    return numbered.filter("fresh").select("visit_key", "ordinal", "node", "event_no").join(lab, ["visit_key", "ordinal"], "left")
