"""Helpers that the corpus operators share: shared storage, reading tables, hashing to the unit interval."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that become one number: 13 x 4 bits fit a double without rounding.
UNIT_DIGITS = 13

#: What a batch for Python workers may hold under ``small_batches``: they hold a few copies of a batch of texts.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where the session leaves that unset, a
    folder of the warehouse, which is shared too; one at a local path is not, and that is an error. A session in one process
    (tests) gets a temporary folder instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siloway.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siloway"
            if folder.startswith(("file:", "/")):
                raise ValueError("executors do not share a local warehouse: set spark.checkpoint.dir")
        spark.conf.set("siloway.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: the rows survive the loss of any executor and are computed once however often they are used.
    """
    return stored(df, new_path(df.sparkSession, what))


def emptied(df: DataFrame, path: str) -> None:
    """Write an empty table over that of ``df`` at ``path``, which nothing reads any more: its disk is free again."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within pass batches of ``BATCH_BYTES`` to Python workers."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it again."""
    spark = df.sparkSession
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_of(seed: int | str, *keys: Column | str) -> Column:
    """MD5 in hex of the seed and the keys as text; null keys count as the empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def unit_of(hexed: Column) -> Column:
    """A number in [0, 1) from the first digits of a hex digest; exact in a double, so SQL engines agree on it."""
    return F.conv(F.substring(hexed, 1, UNIT_DIGITS), 16, 10).cast("double") / F.lit(float(16**UNIT_DIGITS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with those columns renamed that only letter case tells from ``names`` or from other columns, which Spark would
    call ambiguous; and the way back, new name to old, for ``together``."""
    lower = [c.lower() for c in df.columns]
    clash = {n.lower() for n in names} | {c for c in lower if lower.count(c) > 1}
    shown = [c if c in names or c.lower() not in clash else f"_apart_{i}" for i, c in enumerate(df.columns)]
    back = {new: old for new, old in zip(shown, df.columns, strict=True) if new != old}
    return (df.toDF(*shown) if back else df), back


def together(df: DataFrame, back: dict[str, str]) -> DataFrame:
    """``df`` with the columns that ``apart`` renamed under their own names."""
    return df.toDF(*[back.get(c, c) for c in df.columns]) if back else df
