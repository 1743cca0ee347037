"""Circuits and route classification: catalog lookup, best match of a sequence, shares by operation and destination, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.dims import PRODUCT_ORDER
from siloway.functions.scalar import base_code, camera_sector, normal_code, product_label

OTHERS, UNCLASSIFIED, TONNES_PER_TRUCK = "Otros", "Sin clasificar", 26


def circuit_lookup(trips: DataFrame, circuits: DataFrame) -> DataFrame:
    """Trips with the first catalog circuit whose code is the trip's, or whose other codes hold it or its base; null if none.

    Codes are looked up once per distinct (site, code) against the catalog exploded to (site, key), so the facts are
    joined to a table of a few rows per site.
    """
    codes = trips.select("site_id", "circuit").distinct().withColumn("norm", normal_code(F.col("circuit"))).withColumn("base", base_code(F.col("norm")))
    own = circuits.select("site_id", "ordinal", F.upper("code").alias("key"), F.lit(False).alias("by_base"))
    other = circuits.select("site_id", "ordinal", F.explode("equivalents").alias("key"))
    keys = own.unionByName(other.withColumn("by_base", F.lit(False))).unionByName(other.withColumn("by_base", F.lit(True)))
    wanted = codes.select("site_id", "circuit", F.col("norm").alias("key"), F.lit(False).alias("by_base")).unionByName(codes.select("site_id", "circuit", F.col("base").alias("key"), F.lit(True).alias("by_base")))
    first = wanted.join(F.broadcast(keys), ["site_id", "key", "by_base"]).groupBy("site_id", "circuit").agg(F.min("ordinal").alias("ordinal"))
    found = first.join(F.broadcast(circuits), ["site_id", "ordinal"]).select("site_id", "circuit", F.col("code").alias("circuit_code"), "circuit_name", "kind", "subkind", "operation")
    return trips.join(found, ["site_id", "circuit"], "left")


def matched_length(sequence: Column, catalog: Column) -> Column:
    """How many of the catalog's sectors, from its start, a sequence goes through in order."""
    return F.aggregate(sequence, F.lit(0), lambda j, s: F.when(s == F.get(catalog, j), j + 1).otherwise(j))


def classify_by_sequence(trips: DataFrame, circuits: DataFrame, least: float = 0.6) -> DataFrame:
    """Trips with the circuit whose sequence theirs follows best: an equal one at once, else the highest score, first of equals.

    A whole catalog sequence found in order scores its length, a part of it its share. Distinct sequences are matched.
    """
    own = F.filter(F.transform("sectors", camera_sector), lambda s: s != "")
    sequences = trips.select("site_id", own.alias("own")).distinct()
    catalog = circuits.filter(F.size("sequence") > 0).select("site_id", "ordinal", "code", F.transform("sequence", camera_sector).alias("catalog"))
    pairs = sequences.join(F.broadcast(catalog), "site_id").withColumn("matched", matched_length(F.col("own"), F.col("catalog")))
    whole = F.size("catalog")
    score = F.when(F.col("matched") == whole, whole.cast("double")).otherwise(F.col("matched") / whole)
    pairs = pairs.withColumn("score", score).withColumn("exact", F.col("own") == F.col("catalog")).filter("score > 0")
    rank = F.struct("exact", F.when(F.col("exact"), 0.0).otherwise(F.col("score")).alias("s"), -F.col("ordinal"))
    best = pairs.groupBy("site_id", "own").agg(F.max_by(F.struct("code", "score", "exact"), rank).alias("b")).filter(F.col("b.exact") | (F.col("b.score") >= least))
    return trips.withColumn("own", own).join(best, ["site_id", "own"], "left").withColumn("sequence_code", F.col("b.code")).drop("own", "b")


def states(trips: DataFrame, by: list[str]) -> DataFrame:
    """Counts of complete, varied and anomalous trips, the valid total, and the anomalous share; other states are anomalous."""
    done, varied = F.count_if(F.col("state") == "VALIDADO"), F.count_if(F.col("state") == "CON_OBSERVACIONES")
    found = trips.groupBy(*by).agg(F.count(F.lit(1)).alias("trips"), done.alias("complete"), varied.alias("varied"))
    found = found.withColumn("anomalous", F.col("trips") - F.col("complete") - F.col("varied")).withColumn("valid", F.col("complete") + F.col("varied"))
    return found.withColumn("anomalous_pct", F.col("anomalous") / F.col("trips") * 100)


def operations(looked_up: DataFrame, operation_dim: DataFrame) -> DataFrame:
    """Trips that are not anomalous by site and operation, every operation present."""
    found = looked_up.filter("state <> 'ANOMALO'").groupBy("site_id", "operation").agg(F.count(F.lit(1)).alias("trips"))
    spine = looked_up.select("site_id").distinct().crossJoin(F.broadcast(operation_dim))
    return spine.join(found, ["site_id", "operation"], "left").fillna(0, ["trips"]).select("site_id", "operation", "operation_name", "trips")


def folded(counts: DataFrame, by: list[str], name: str, count: str, top: int) -> DataFrame:
    """The ``top`` names of each group by count, ties by name, and the rest together as one."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), name))
    label = F.when(F.col("_rank") <= top, F.col(name)).otherwise(OTHERS)
    return counts.filter(F.col(count) > 0).withColumn("_rank", rank).groupBy(*by, label.alias(name)).agg(F.sum(count).alias(count))


def destinations(looked_up: DataFrame, top: int = 5) -> DataFrame:
    """Destinations of trips that are not anomalous by site and operation: the top ones and the rest, with shares."""
    counts = looked_up.filter("state <> 'ANOMALO' and operation is not null").groupBy("site_id", "operation", F.col("circuit_name").alias("destination")).agg(F.count(F.lit(1)).alias("trips"))
    total = counts.groupBy("site_id", "operation").agg(F.sum("trips").alias("total"))
    return folded(counts, ["site_id", "operation"], "destination", "trips", top).join(total, ["site_id", "operation"]).withColumn("pct", F.col("trips") / F.col("total") * 100).drop("total")


def with_product(trips: DataFrame) -> DataFrame:
    return trips.withColumn("product", product_label(F.col("product_type"), F.col("trip_id")))


def of_product(trips: DataFrame, product: str | None) -> DataFrame:
    """Trips of a product; none or 'Todos' for all."""
    return trips if not product or product == "Todos" else trips.filter(F.col("product") == product)


def security(trips: DataFrame, by: list[str], tonnes: int = TONNES_PER_TRUCK) -> DataFrame:
    return states(trips, by).withColumn("anomalous_tonnes", F.col("anomalous") * tonnes)


def multilevel(looked_up: DataFrame, top: int = 7) -> DataFrame:
    """(site_id, level, name, trips): valid and anomalous, anomalous by product, complete by destination folded."""
    kind = F.when(F.col("state") == "ANOMALO", "anomalos").otherwise("validos")
    first = looked_up.groupBy("site_id", F.lit("estado").alias("level"), kind.alias("name")).agg(F.count(F.lit(1)).alias("trips"))
    second = looked_up.filter("state = 'ANOMALO'").groupBy("site_id", F.lit("producto").alias("level"), F.col("product").alias("name")).agg(F.count(F.lit(1)).alias("trips"))
    done = looked_up.filter("state = 'VALIDADO'").groupBy("site_id", F.lit("destino").alias("level"), F.coalesce("circuit_name", F.lit(UNCLASSIFIED)).alias("name")).agg(F.count(F.lit(1)).alias("trips"))
    return first.unionByName(second).unionByName(folded(done, ["site_id", "level"], "name", "trips", top))


def product_options(trips: DataFrame) -> DataFrame:
    names = trips.select("product").distinct()
    return names.unionByName(trips.sparkSession.createDataFrame([("Todos",)], "product string"))


def duration_by_circuit(trips: DataFrame) -> DataFrame:
    return trips.groupBy("site_id", F.coalesce("circuit", F.lit("N/A")).alias("circuit")).agg(F.avg("stay").alias("mean_stay"), F.count(F.lit(1)).alias("trips"))


def valid_bars(looked_up: DataFrame) -> DataFrame:
    """Trips that are not anomalous by operation and destination, with the distinct circuit codes behind each bar."""
    return looked_up.filter("state <> 'ANOMALO' and operation is not null").groupBy("site_id", "operation", F.col("circuit_name").alias("destination")).agg(
        F.count(F.lit(1)).alias("trips"), F.array_join(F.array_sort(F.collect_set("circuit_code")), ",").alias("codes")
    )


def enriched(looked_up: DataFrame) -> DataFrame:
    """Trips with the texts that a table shows for what the catalog lacks."""
    code, name = F.coalesce("circuit_code", "circuit"), F.coalesce("circuit_name", F.lit("Sin catálogo"))
    words = {"cir": "N/A", "vue": "N/A", "description": "Sin descripción disponible"}
    shown = {c: F.coalesce(F.col(c) if c in looked_up.columns else F.lit(None).cast("string"), F.lit(v)) for c, v in words.items()}
    return looked_up.withColumns({"catalog_code": code, "catalog_name": name, **shown})


def product_order(product: Column) -> Column:
    """The place of a product among anomalous ones; unknown ones come last and go by name."""
    out = F.lit(50)
    for i, p in enumerate(PRODUCT_ORDER):
        out = F.when(F.lower(product) == p.lower(), i).otherwise(out)
    return out


def anomalous_products(looked_up: DataFrame) -> DataFrame:
    """(site_id, position, product, trips): anomalous trips by product in the fixed order. A site has a few products."""
    counts = looked_up.filter("state = 'ANOMALO'").groupBy("site_id", "product").agg(F.count(F.lit(1)).alias("trips"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy(product_order(F.col("product")), "product")))
