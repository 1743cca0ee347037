"""Positions in a total order, without a task that sorts it: rows are ranked within slots and slots are counted.

A slot is a stretch of the order: an hour of exits, a prefix of plates, an envelope of a file. Counts by slot, of which there are
few, give each slot its offset as a prefix sum; only a slot's own rows are ranked together. Everything is declarative, so a
lost executor's part is worked out again with the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots whose counts are summed together before the sums themselves are: no prefix sum runs over all slots of a table.
BLOCK = 1024


def _offsets(slots: DataFrame, by: list[str], order: str) -> DataFrame:
    """``slots`` (by, order, size) with ``offset``, the rows of earlier slots of its group."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")))


def positioned(rows: DataFrame, by: list[str], slot: Column, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in each group's order. ``slot`` never falls along ``order``; a null slot comes first.

    ``order`` has to be total for the places to be definite.
    """
    held = rows.withColumn("_slot", slot)
    sizes = held.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("size"))
    offsets = _offsets(sizes, by, "_slot").select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slot").alias("_of"), "offset")
    rank = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy(*order))
    same = F.col("_slot").eqNullSafe(F.col("_of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranked = held.withColumn("_rank", rank).join(offsets, same)
    return ranked.withColumn(name, (F.col("offset") + F.col("_rank")).cast("long")).select(*rows.columns, name)


def running_index(rows: DataFrame, part: str, piece: str, within: str, name: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in the whole input: parts in order, their pieces in order, and ``within`` (0, 1, ...)
    a piece. Pieces are counted, never sorted: parts are few (plants), pieces may be many (files)."""
    sizes = rows.groupBy(part, piece).agg(F.count(F.lit(1)).alias("size"))
    inside = _offsets(sizes, [part], piece)
    totals = sizes.groupBy(part).agg(F.sum("size").alias("rows_of_part"))
    before = totals.select(F.col(part).alias("_earlier"), "rows_of_part")
    starts = totals.select(part).join(F.broadcast(before), F.col("_earlier") < F.col(part), "left").groupBy(part).agg(F.coalesce(F.sum("rows_of_part"), F.lit(0)).alias("start"))
    offsets = inside.join(starts, part).select(part, piece, (F.col("start") + F.col("offset")).alias("_offset"))
    return rows.join(offsets, [part, piece]).withColumn(name, (F.col("_offset") + F.col(within)).cast("long")).drop("_offset")


def paired(left: DataFrame, right: DataFrame, left_order: tuple[Column, list[Column]], right_order: tuple[Column, list[Column]]) -> DataFrame:
    """Rows of two tables side by side by their place alone: the n-th with the n-th, columns of both and ``position``.

    An order is (slot, columns) as in ``positioned``. Tables of different lengths fail the job when read: the check is in the
    position that comes out, so no optimiser can leave it out where positions are read.
    """
    one = positioned(left.withColumn("_all", F.lit(0)), ["_all"], *left_order).drop("_all").withColumn("_left", F.lit(True))
    two = positioned(right.withColumn("_all", F.lit(0)), ["_all"], *right_order).drop("_all").withColumn("_right", F.lit(True))
    both = one.join(two, "position", "full")
    alone = F.col("_left").isNull() | F.col("_right").isNull()
    checked = F.when(alone, F.raise_error(F.lit("the tables differ in number of rows")).cast("long")).otherwise(F.col("position"))
    return both.withColumn("position", checked).drop("_left", "_right")
