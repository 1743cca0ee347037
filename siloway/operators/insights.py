"""Readings in words of stay distributions and of flow, and radars side by side. A few rows per site, built from aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloway.operators.stats import radar

# The sentences are fixed values: reports are compared by them.


def grouped(x: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def decimals(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x.cast("double"))


def _rows(df: DataFrame, by: list[str], lines: list[Column]) -> DataFrame:
    """(by, position, sentence) of the sentences that are not null; a fallback if none is."""
    said = F.filter(F.array(*lines), lambda s: s.isNotNull())
    said = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("No hay datos suficientes para generar conclusiones.")))
    return df.select(*by, F.posexplode(said).alias("position", "sentence"))


def stay_insights(stats: DataFrame, shape: DataFrame | None, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """What a report says of stays in hours. ``stats`` is ``stay_time_stats``, ``shape`` is ``shape_indicators`` with ``mode`` added; without
    it, the stays' own mode is told in their place. A group of ``groups`` without stays gets the line that says so."""
    of_shape = ["shape_mode", "peak", "en_rango_central_pct", "en_cola_derecha_pct"]
    if shape is None:
        rows = stats.select("*", *[F.lit(None).cast("double").alias(c) for c in of_shape])
    else:
        rows = stats.join(shape.select(*by, F.col("mode").alias("shape_mode"), *of_shape[1:]), by, "left")
    if groups is not None:
        rows = groups.select(*by).distinct().join(rows, by, "left")
    shaped, some = F.col("shape_mode").isNotNull(), F.coalesce(F.col("n"), F.lit(0)) > 0
    gap = F.col("mode_median_gap")
    lines = [
        F.when(shaped, F.concat(F.lit("La mayor concentración de camiones se ubica alrededor de "), decimals(F.col("shape_mode"), 1), F.lit(" h, con un pico estimado de "), grouped(F.col("peak")), F.lit(" camiones.")))
        .otherwise(F.concat(F.lit("La mayor concentración de camiones se ubica alrededor de "), decimals(F.col("mode"), 1), F.lit(" horas."))),
        F.when(shaped, F.concat(F.lit("El "), decimals(F.col("en_rango_central_pct"), 0), F.lit("% de los camiones se encuentra dentro del rango central esperado."))),
        F.when(shaped, F.concat(F.lit("El "), decimals(F.col("en_cola_derecha_pct"), 0), F.lit("% de los camiones se ubica en la cola derecha de la distribución."))),
        F.concat(F.lit("El 90% de los camiones egresa antes de "), decimals(F.col("p90"), 1), F.lit(" horas.")),
        F.concat(F.lit("El 50% central de la operación se mueve dentro de un rango de "), decimals(F.col("iqr"), 1), F.lit(" horas ("), decimals(F.col("q1"), 1), F.lit("–"), decimals(F.col("q3"), 1), F.lit(" h).")),
        F.when(gap < 0.5, "La distancia entre moda y mediana sugiere una distribución estable y coherente.")
        .when(gap < 1.5, "La distancia entre moda y mediana indica una ligera asimetría en la distribución.")
        .otherwise("La distancia entre moda y mediana sugiere una distribución sesgada o mezcla de comportamientos."),
    ]
    return _rows(rows, by, [F.when(some, line) for line in lines])


def slot_label(slot: Column) -> Column:
    return F.format_string("D%d %02d", F.floor(slot / 24) + 1, slot % 24)


def flow_insights(metrics: DataFrame, kpis: DataFrame) -> DataFrame:
    """What a report says of a week's flow. ``metrics`` is ``flow_saturation``, ``kpis`` is ``ingress_kpis``."""
    shown = kpis.select("site_id", "peak_slot", "best_day", "best_day_arrivals", "best_band", "best_band_arrivals", "best_band_per_hour", "arrivals_per_hour", "backlog", "backlog_start", "backlog_end", F.col("peak_arrivals").alias("ingress_peak"))
    rows = metrics.withColumnRenamed("peak_slot", "in_plant_slot").join(shown, "site_id")
    crossed = F.concat_ws(
        " y ", F.when(F.col("alert_crossings") > 0, F.concat(F.col("alert_crossings"), F.lit(" cruces del umbral de alerta"))), F.when(F.col("saturation_crossings") > 0, F.concat(F.col("saturation_crossings"), F.lit(" cruces del umbral de saturación")))
    )
    lines = [
        F.when(F.col("peak") > 0, F.concat(F.lit("La planta alcanzó un pico de "), grouped(F.col("peak")), F.lit(" camiones en planta a las "), slot_label(F.col("in_plant_slot")), F.lit("."))),
        F.when(F.col("hours_over") > 0, F.concat(F.lit("Se registraron "), F.col("hours_over"), F.lit(" horas por encima del umbral de saturación ("), decimals(F.col("pct_over"), 1), F.lit("% del tiempo)."))),
        F.when((F.col("p90") > 0) & (F.col("peak") > 0) & (F.col("p90") / F.col("peak") >= 0.9), F.concat(F.lit("El P90 ("), F.floor(F.col("p90") + 0.5), F.lit(") está cerca del pico ("), F.col("peak"), F.lit("): la planta pasa buena parte del tiempo cerca del límite."))),
        F.when(crossed != "", F.concat(F.lit("Se atravesó el umbral "), crossed, F.lit("."))),
        F.when(F.col("ingress_peak") > 0, F.concat(F.lit("El mayor pico de llegadas fue de "), F.col("ingress_peak"), F.lit(" camiones/h ("), slot_label(F.col("peak_slot")), F.lit(")."))),
        F.when((F.col("best_day_arrivals") > 0) & (F.col("best_day") != "—"), F.concat(F.lit("El día con más ingresos fue "), F.col("best_day"), F.lit(" con "), grouped(F.col("best_day_arrivals")), F.lit(" camiones entrando."))),
        F.when(
            (F.col("best_band") != "—") & (F.col("best_band_arrivals") > 0),
            F.concat(F.lit("La franja crítica (8h con más llegadas) es "), F.col("best_band"), F.lit(": "), F.col("best_band_arrivals"), F.lit(" camiones ("), decimals(F.col("best_band_per_hour"), 1), F.lit(" cam/h). Promedio general: "), decimals(F.col("arrivals_per_hour"), 1), F.lit(" cam/h.")),
        ),
        F.when(F.col("backlog") > 0, F.concat(F.lit("Backlog: +"), F.col("backlog"), F.lit(" camiones acumulados ("), slot_label(F.col("backlog_start")), F.lit("–"), slot_label(F.col("backlog_end")), F.lit("). Ocurre cuando entran más camiones de los que salen."))),
        F.when(F.coalesce(F.col("recovery_hours"), F.lit(0)) > 0, F.concat(F.lit("El episodio de saturación más largo duró "), F.col("recovery_hours"), F.lit(" horas."))),
    ]
    return _rows(rows, ["site_id"], lines)


def merged_radar(current: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """The stay radar of two periods side by side: metric, value, score, and the other period's score (null without it)."""
    return radar(current, by).join(radar(other, by).select(*by, "metric", F.col("score").alias("score_compare")), [*by, "metric"], "left")


def multilevel_insight(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(site_id, kind, text): the most frequent destination of complete trips (``parts`` is ``routes.multilevel``), or where there
    is none the most frequent operation of valid trips (``counts``: site_id, operation name, trips)."""
    top = parts.filter("level = 'destino'").groupBy("site_id").agg(F.min_by("name", F.struct(F.col("name") == "Otros", -F.col("trips"), F.col("name"))).alias("name"))
    first = top.select("site_id", F.lit("destino_frecuente").alias("kind"), F.concat(F.lit("Destino más frecuente (completos): "), "name").alias("text"))
    best = counts.filter("trips > 0").groupBy("site_id").agg(F.min_by("operation_name", F.struct(-F.col("trips"), F.col("operation_name"))).alias("name")).join(top, "site_id", "left_anti")
    second = best.select("site_id", F.lit("operacion_dominante").alias("kind"), F.concat(F.lit("Operación dominante (válidos): "), "name").alias("text"))
    return first.unionByName(second)
