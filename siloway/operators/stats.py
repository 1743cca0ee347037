"""Distribution statistics of a numeric column, over all rows or by groups. Empty groups give 0 where the domain wants a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siloway.functions.dims import SHAPE_RADAR, STAY_RADAR
from siloway.functions.scalar import outlier_class

#: Standard deviations above the mean that put a stay out of range.
OUT_OF_RANGE_STD = 2.0


def std(x: str) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def mean(x: str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


#: Slots of value in a doubling of 1 + |x|: each holds a ten-thousandth of a group's values or so.
SLOTS = 8192


def slot_of(x: Column) -> Column:
    """A whole number that never falls as x grows: in which stretch of values x lies. It needs no bounds of the data."""
    step = F.floor(F.log2(1 + F.abs(x)) * SLOTS)
    return F.when(F.isnan(x), F.lit(1 << 40)).otherwise(F.when(x < 0, -step).otherwise(step)).cast("long")


def counted(df: DataFrame, by: list[str], x: str, ordinal: str | None = None) -> DataFrame:
    """(by, _x, _c, _first): each group's values with their number and first ordinal. Parts of a table add up to those of the whole,
    and every figure of a distribution follows from it."""
    first = F.min(ordinal) if ordinal else F.lit(0)
    return df.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"), first.alias("_first"))


def figures(df: DataFrame, by: list[str], x: str, shares: dict[str, float], ordinal: str | None = None, multiplier: float | None = None) -> DataFrame:
    """(by, n, mean, std, min, max, mode, over_count, one column per name of ``shares``) of each group's values, nulls apart.

    Rows are counted by value once, values are summed by slot, and slots, a few ten thousand a group, by group. Percentiles are
    exact, with linear interpolation: running totals of slots give the ranks of their values, which are ordered within their
    slot alone. Second moments are taken about a point of each slot, so nothing cancels out. ``over_count`` is the number of
    values over mean + multiplier * std.
    """
    names = by or ["_all"]
    values = counted(df if by else df.withColumn("_all", F.lit(0)), names, x, ordinal).withColumn("_slot", slot_of(F.col("_x"))).withColumn("_real", F.when(F.col("_x").isNotNull(), F.col("_c")).otherwise(0))
    size = F.signum("_slot") * (F.pow(F.lit(2.0), F.abs("_slot") / SLOTS) - 1)
    off = F.col("_x") - size
    slots = values.groupBy(*names, "_slot").agg(
        F.sum("_real").alias("_n"), F.coalesce(F.sum(F.col("_real") * off), F.lit(0.0)).alias("_a"), F.coalesce(F.sum(F.col("_real") * off * off), F.lit(0.0)).alias("_b"),
        F.max(F.when(F.col("_x").isNotNull(), F.struct("_c", (-F.col("_first")).alias("f"), "_x"))).alias("_top"),
    )
    whole, before = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(size, F.lit(0.0))
    slots = slots.withColumn("_all_n", F.sum("_n").over(whole)).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_best", F.max("_top").over(whole))
    slots = slots.withColumn("_mean", F.try_divide(F.sum(F.col("_a") + F.col("_n") * own).over(whole), F.col("_all_n")))
    apart = F.col("_mean") - own
    slots = slots.withColumn("_m2", F.sum(F.col("_b") - 2 * apart * F.col("_a") + F.col("_n") * apart * apart).over(whole))
    slots = slots.withColumn("_std", F.when(F.col("_all_n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_m2")) / (F.col("_all_n") - 1))).otherwise(0.0))
    limit = F.coalesce(F.col("_mean"), F.lit(0.0)) + (multiplier or 0.0) * F.col("_std")
    told = slots.select(*[F.col(c).alias(f"_of_{c}") for c in names], F.col("_slot").alias("_of"), "_start", "_all_n", "_mean", "_std", F.col("_best._x").alias("_mode"), limit.alias("_limit"))

    # each value with what its slot and its group say; only values of one slot are ordered together
    same = F.col("_slot").eqNullSafe(F.col("_of"))
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = values.join(told, same)
    rows = rows.withColumn("_upto", F.col("_start") + F.sum("_real").over(Window.partitionBy(*names, "_slot").orderBy("_x", "_first"))).withColumn("_from", F.col("_upto") - F.col("_real"))

    def at(share: float) -> Column:
        """The value at a share of the ranks: a value's weight is that of the two ranks about it that the value covers."""
        place = F.lit(share) * (F.col("_all_n") - 1)
        part = place - F.floor(place)
        low = F.when((F.floor(place) >= F.col("_from")) & (F.floor(place) < F.col("_upto")), 1 - part).otherwise(0.0)
        high = F.when((part > 0) & (F.floor(place) + 1 >= F.col("_from")) & (F.floor(place) + 1 < F.col("_upto")), part).otherwise(0.0)
        return F.sum(F.when(low + high > 0, F.col("_x") * (low + high)))

    out = rows.groupBy(*names).agg(
        F.max("_all_n").alias("n"), F.max("_mean").alias("mean"), F.max("_std").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.max("_mode").alias("mode"), F.max("_limit").alias("threshold"),
        F.sum(F.when(F.col("_x") > F.col("_limit"), F.col("_c")).otherwise(0)).alias("over_count"), *[at(p).alias(name) for name, p in shares.items()],
    )
    return out if by else out.drop("_all")


def ranked_quantiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column per name): exact percentiles with linear interpolation, without a buffer or a window per group; groups
    without values are left out."""
    return figures(df, by, x, shares).filter("n > 0").select(*by, *shares)


def mode(df: DataFrame, by: list[str], x: str, ordinal: str) -> DataFrame:
    """The most frequent value of each group; of equals, the one seen first by ``ordinal``. Two partial aggregations."""
    counted = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(x, F.struct(F.col("n"), -F.col("first"))).alias("mode"), F.max("n").alias("mode_count"))


def stay_time_stats(df: DataFrame, by: list[str], x: str, ordinal: str, multiplier: float = OUT_OF_RANGE_STD) -> DataFrame:
    """The eighteen figures of a stay-time distribution, by group, all from one count of values (``figures``)."""
    shares = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}
    base = figures(df, by, x, shares, ordinal, multiplier).fillna(0.0, ["mean", *shares])
    return base.select(
        *by, "n", "mean", "median", "mode", "min", "max", "std", "p5", "p90", "p95", "q1", "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean") * 100).alias("cv"),
        "threshold", "over_count",
        F.try_divide(F.col("over_count"), F.col("n")).cast("double").alias("_share"),
        F.abs(F.col("mode") - F.col("median")).alias("mode_median_gap"),
    ).withColumn("over_pct", F.col("_share") * 100).drop("_share")


def z_scored(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Rows with ``z``, their distance from the group's mean in standard deviations; 0 where the deviation is 0.

    Groups are aggregated first and the moments joined back, so a large group is not gathered in one window.
    """
    m = df.groupBy(*by).agg(F.avg(x).alias("_m"), std(x).alias("_s"), F.count(x).alias("_n"))
    joined = df.join(m, by) if by else df.crossJoin(F.broadcast(m))
    return joined.withColumn("z", F.when(F.col("_s") > 0, (F.col(x) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def variability(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Deviation, coefficient of variation, and counts of the four outlier classes; under two values everything is normal."""
    z = z_scored(df, by, x).withColumn("kind", outlier_class(F.col("z")))
    return z.groupBy(*by).agg(
        std(x).alias("std"),
        F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(std(x) / F.avg(x) * 100).alias("cv"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("normal", "alto_desvio", "outlier", "extremo")],
    )


def outliers_z(df: DataFrame, by: list[str], x: str, limit: float = 3.0) -> DataFrame:
    """Rows further than ``limit`` standard deviations from their group's mean; groups under three rows have none."""
    return z_scored(df, by, x).filter((F.abs("z") > limit) & (F.col("_n") >= 3)).drop("_n")


def outliers_iqr(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Rows beyond one and a half interquartile ranges from the quartiles; groups under four rows have none."""
    ranks, counts = ranked_quantiles(df, by, x, {"_q1": 0.25, "_q3": 0.75}), df.groupBy(*by).agg(F.count(x).alias("_n")).filter("_n >= 4")
    q = ranks.join(counts, by) if by else ranks.crossJoin(counts)
    joined = df.join(q, by) if by else df.crossJoin(F.broadcast(q))
    spread = 1.5 * (F.col("_q3") - F.col("_q1"))
    return joined.filter((F.col(x) < F.col("_q1") - spread) | (F.col(x) > F.col("_q3") + spread)).drop("_q1", "_q3", "_n")


def gaussian_curve(df: DataFrame, x: str, peak: float, steps: int = 50, spread: float = 3.0) -> DataFrame:
    """steps + 1 points of peak * exp(-z^2 / 2) over mean +- spread deviations; none if the deviation is 0."""
    m = df.agg(F.avg(x).alias("m"), std(x).alias("s")).filter("s > 0")
    points = m.select("m", "s", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    z = -spread + 2 * spread * F.col("i") / steps
    return points.select("i", (F.col("m") + z * F.col("s")).alias("x"), (F.lit(peak) * F.exp(-z * z / 2)).alias("y"))


def kde_curve(df: DataFrame, x: str, points: int = 80, padding: float = 0.1) -> DataFrame:
    """Gaussian kernel density on a grid, and the curve scaled so that its area is the number of rows.

    The sample is first reduced to distinct values with counts; the grid is a few dozen rows, so it is what is broadcast.
    """
    m = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), std(x).alias("s"), F.min(x).alias("low"), F.max(x).alias("high"))
    span = (F.col("high") - F.col("low")) / 4
    sigma = F.when(F.col("s") > 0, F.col("s")).otherwise(F.greatest(F.lit(1e-6), F.when(span == 0, 0.1).otherwise(span)))
    m = m.filter("n > 0").withColumn("sigma", sigma)
    m = m.withColumn("h", F.greatest(F.col("sigma") * 1.06 * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.col("sigma") * 0.2))
    m = m.withColumn("start", F.greatest(F.lit(0.0), F.col("low") - padding)).withColumn("step", (F.col("high") + padding - F.col("start")) / (points - 1))
    grid = m.select("n", "h", "start", "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("x", F.col("start") + F.col("i") * F.col("step"))
    values = df.groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    u = (F.col("x") - F.col("v")) / F.col("h")
    kernel = F.col("c") * F.exp(-0.5 * u * u) / F.sqrt(2 * F.pi())
    density = values.crossJoin(F.broadcast(grid)).groupBy("i", "x", "n", "h", "step").agg((F.sum(kernel)).alias("k"))
    density = density.withColumn("density", F.col("k") / (F.col("n") * F.col("h")))
    weight = F.when(F.col("i").isin(0, points - 1), F.col("step") / 2).otherwise(F.col("step"))
    area = density.agg(F.sum(F.col("density") * weight).alias("area"))
    scale = F.when(F.col("area") > 0, F.col("n") / F.col("area")).otherwise(1.0)
    return density.crossJoin(F.broadcast(area)).select("i", "x", "density", (F.col("density") * scale).alias("freq_smoothed"))


def histogram_smoothed(df: DataFrame, x: str, bin_minutes: int = 10, window: int = 5) -> DataFrame:
    """Counts in bins from half an hour to 24 hours, outer values in the end bins, with a centred moving average."""
    bins = -(-1410 // bin_minutes)
    width = bin_minutes / 60
    index = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(x) - 0.5) / width))).cast("int")
    counts = df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(F.broadcast(counts), "bin", "left").fillna(0, ["count"])
    half = window // 2
    smooth = F.avg("count").over(Window.orderBy("bin").rowsBetween(-half, half))
    return full.select("bin", (F.floor((0.5 + (F.col("bin") + 0.5) * width) * 100 + 0.5) / 100).alias("x"), "count", smooth.alias("freq_smoothed"))


def histogram_sparse(df: DataFrame, by: list[str], x: str, size: float) -> DataFrame:
    """Counts of the bins that hold values; a bin starts at floor(value / size) * size, rounded to a tenth."""
    start = F.floor(F.floor(F.col(x) / size) * size * 10 + 0.5) / 10
    return df.groupBy(*by, start.alias("bin_start")).agg(F.count(F.lit(1)).alias("count"))


def binned_mode(df: DataFrame, by: list[str], x: str, size: float) -> DataFrame:
    """Centre of the fullest bin; of equals, the lowest."""
    bins = histogram_sparse(df, by, x, size)
    best = bins.groupBy(*by).agg(F.max_by("bin_start", F.struct(F.col("count"), -F.col("bin_start"))).alias("start"), F.max("count").alias("count"))
    return best.select(*by, (F.col("start") + size / 2).alias("binned_mode"), "count")


def shape_indicators(
    df: DataFrame, by: list[str], x: str, size: float = 1.0, central: str = "media_std", tail: str = "media_std", limit: float | None = None
) -> DataFrame:
    """Rows within the central range, rows beyond the tail limit, and the fullest bin's share.

    The range is mean -+ deviation (not below 0) or the quartiles (``central`` "iqr"); the limit is mean + deviation, the 90th
    percentile (``tail`` "p90") or the one given ("manual").
    """
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), std(x).alias("s"))
    low, high, beyond = F.greatest(F.lit(0.0), F.col("m") - F.col("s")), F.col("m") + F.col("s"), F.col("m") + F.col("s")
    if central != "media_std" or tail == "p90":
        base = base.join(ranked_quantiles(df, by, x, {"q1": 0.25, "q3": 0.75, "p90": 0.9}), by)
    if central != "media_std":
        low, high = F.col("q1"), F.col("q3")
    if tail == "p90":
        beyond = F.col("p90")
    elif tail == "manual" and limit is not None:
        beyond = F.lit(float(limit))
    base = base.select(*by, "n", low.alias("central_min"), high.alias("central_max"), beyond.alias("tail_limit"))
    counted = df.join(base, by).groupBy(*by, "n", "central_min", "central_max", "tail_limit").agg(
        F.count_if(F.col(x).between(F.col("central_min"), F.col("central_max"))).alias("central_count"), F.count_if(F.col(x) > F.col("tail_limit")).alias("tail_count")
    )
    peak = histogram_sparse(df, by, x, size).groupBy(*by).agg(F.max("count").alias("peak"))
    return counted.join(peak, by).select(
        *by, "n", "central_min", "central_max", "tail_limit", "peak", "central_count", "tail_count",
        (F.col("peak") / F.col("n") * 100).alias("pico_frecuencia_pct"),
        (F.col("central_count") / F.col("n") * 100).alias("en_rango_central_pct"),
        (F.col("tail_count") / F.col("n") * 100).alias("en_cola_derecha_pct"),
    )


def score_between(value: Column, low: Column, high: Column, more_is_better: Column) -> Column:
    """0 to 100 between two references, 100 being better."""
    share = (value - low) / (high - low)
    share = F.when(more_is_better, share).otherwise(1 - share)
    return F.when(high <= low, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * share)))


def radar(df: DataFrame, by: list[str], shape: bool = False) -> DataFrame:
    """(group, metric, value, score to a tenth): the stay or the shape metrics of each group against their references."""
    refs = [(m, a, b, False) for m, a, b in STAY_RADAR] if not shape else SHAPE_RADAR
    reference = df.sparkSession.createDataFrame(refs, "metric string, low double, high double, more boolean")
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m, *_ in refs)
    long = df.select(*by, F.expr(f"stack({len(refs)}, {pairs}) as (metric, value)"))
    score = score_between(F.col("value"), F.col("low"), F.col("high"), F.col("more"))
    return long.join(F.broadcast(reference), "metric").select(*by, "metric", "value", (F.floor(score * 10 + 0.5) / 10).alias("score"))


def radar_total(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("final_score"), F.count(F.lit(1)).alias("metrics"))


def histogram_overlay(df: DataFrame, by: list[str], x: str, size: float) -> DataFrame:
    """Bins with the normal curve of the group's moments at their start, scaled to the fullest bin, and the class of the bar:
    central, cola (beyond the tail limit) or resto."""
    bins, shape = histogram_sparse(df, by, x, size), shape_indicators(df, by, x, size)
    moments = df.groupBy(*by).agg(F.avg(x).alias("m"), std(x).alias("s"))
    at = bins.join(shape.select(*by, "peak", "central_min", "central_max", "tail_limit"), by).join(moments, by)
    start = F.col("bin_start")
    z = (start - F.col("m")) / F.col("s")
    kind = F.when(start.between(F.col("central_min"), F.col("central_max")), "central").when(start > F.col("tail_limit"), "cola").otherwise("resto")
    return at.select(*by, "bin_start", "count", F.when(F.col("s") > 0, F.col("peak") * F.exp(-0.5 * z * z)).otherwise(0.0).alias("normal"), kind.alias("kind"))
