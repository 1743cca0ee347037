"""Tables that Spark writes on the way: where they lie, and writing and reading them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a folder of the warehouse. A session in one
    process gets a temporary folder; a cluster whose warehouse is a local path has none, and that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siloway.shared.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
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


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet, over what was there, and read again: worked out once, and no executor's loss undoes it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
