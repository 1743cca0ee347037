"""Trucks on the plant as the route view shows them: operation type, sector, panels, and the search of circuits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siloway.functions.dims import FLEET_PANELS, OPERATION_TYPES
from siloway.functions.scalar import round_half_up, truck_sector_code
from siloway.operators.routes import circuit_lookup


def trucks(in_plant: DataFrame, circuits: DataFrame) -> DataFrame:
    """Trucks on the plant with circuit code and name, operation type and sector code.

    ``in_plant`` has trip_id, site_id, circuit, current_sector, current_camera and cameras (array). A code that the
    catalog lacks stands for the first circuit of the plant.
    """
    first = circuits.groupBy("site_id").agg(F.min_by(F.struct("code", "circuit_name", "kind"), "ordinal").alias("first"))
    found = circuit_lookup(in_plant, circuits).join(F.broadcast(first), "site_id", "left")
    known = F.col("circuit_code").isNotNull()
    kind = F.when(known, F.col("kind")).otherwise(F.col("first.kind"))
    operation = F.lit("TRANSILE")
    for name, shown in OPERATION_TYPES.items():
        operation = F.when(kind == name, shown).otherwise(operation)
    last = F.when(F.size("cameras") > 0, F.element_at("cameras", -1))
    return found.select(
        "trip_id", "site_id", F.when(known, F.col("circuit_code")).otherwise(F.col("first.code")).alias("circuit_code"), F.when(known, F.col("circuit_name")).otherwise(F.col("first.circuit_name")).alias("circuit_name"),
        operation.alias("operation_type"), truck_sector_code(last, F.lit(None).cast("string"), F.col("current_sector"), F.col("current_camera")).alias("sector_code"),
    )


def of_operation(fleet: DataFrame, operation: str = "ALL") -> DataFrame:
    return fleet if operation == "ALL" else fleet.filter(F.col("operation_type") == operation)


def panels(fleet: DataFrame, sites: DataFrame, operation: str = "ALL") -> DataFrame:
    """(site_id, panel, label, trucks, pct): trucks by operation group, of all trucks or of one operation's; every group of every
    site is present, 0 of 0 is 0 percent."""
    counts = of_operation(fleet, operation).groupBy("site_id", "operation_type").agg(F.count(F.lit(1)).alias("trucks"))
    totals = counts.groupBy("site_id").agg(F.sum("trucks").alias("total"))
    groups = fleet.sparkSession.createDataFrame(FLEET_PANELS, "panel string, label string, operation_type string")
    full = sites.select("site_id").crossJoin(F.broadcast(groups)).join(counts, ["site_id", "operation_type"], "left").join(totals, "site_id", "left").fillna(0, ["trucks", "total"])
    share = F.when(F.col("total") > 0, round_half_up(F.col("trucks") / F.col("total") * 100)).otherwise(0)
    return full.select("site_id", "panel", "label", "trucks", share.alias("pct"))


def search_circuits(circuits: DataFrame, text: str) -> DataFrame:
    """Circuits whose code or name holds a text, in any letter case; an empty text keeps all."""
    t = text.strip().upper()
    return circuits if not t else circuits.filter(F.upper("code").contains(t) | F.upper("circuit_name").contains(t))
