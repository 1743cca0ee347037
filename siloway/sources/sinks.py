"""Exports of one file: ordered lines by one task, named only once they are whole. CSV with meta lines, JSON envelopes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from siloway.sources.files import csv_lines

FORMAT = "siloway_one_file"


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """A task writes what it gets beside the target; the commit gives the file its name, and an abort removes it."""

    def __init__(self, path: str, between: str) -> None:
        self.path, self.between = path, between

    def write(self, iterator: Iterator[Row]) -> _Written:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        aside = f"{at}.{uuid.uuid4().hex}.part"
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        inside = False
        try:
            with store.open_output_stream(aside) as out:
                for row in iterator:
                    out.write(((self.between if inside and row["item"] else "") + row["line"]).encode())
                    inside = row["item"]
        except BaseException:
            store.delete_file(aside)
            raise
        return _Written(aside)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        made = [m.path for m in messages if m]
        if len(made) != 1:
            raise ValueError(f"{len(made)} tasks wrote one file")
        store.move(made[0], at)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class OneFile(DataSource):
    """Write rows (line: string, item: boolean) to one file, in order; ``between`` goes between two items that follow each other.

    ``path`` is a URI, or an absolute path, that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string, item boolean"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("between", ""))


def write_lines(rows: DataFrame, order: list[Column], path: str, between: str = "") -> None:
    """Write (line, item, ...) in an order to one file. Rows are sorted by all tasks and then handed to one, a part after another, so
    only its stream of bytes is not divided. The file is replaced when all is written; a failure leaves the old one."""
    rows.sparkSession.dataSource.register(OneFile)
    lines = rows.orderBy(*order).select("line", "item").coalesce(1)
    lines.write.format(FORMAT).option("path", path).option("between", between).mode("append").save()


def export_csv(df: DataFrame, path: str, order: list[str], meta: dict[str, str] | None = None) -> None:
    """One CSV file: lines of meta data, the header, and the rows in the order of their columns ``order``. Nothing is written for a
    table without rows, and the last line has no newline."""
    if df.limit(1).count() == 0:
        return
    keys = [f"_k{i}" for i in range(len(order))]
    lines = csv_lines(df, meta, {k: F.col(c) for k, c in zip(keys, order, strict=True)})
    write_lines(lines.withColumn("item", F.lit(True)), [F.col("part"), F.col("place"), *[F.col(k) for k in keys]], path, between="\n")


def write_envelope(df: DataFrame, base: str, scenario: str, plant: str | None, name: str, order: list[str], payload: str = "data", generated_at: str = "") -> str:
    """A JSON envelope ``base/scenario[/plant]/name`` of the rows in an order, and its path. A plant's envelope names it."""
    head = {"version": "1.0", "generatedAt": generated_at, "scenario": scenario} | ({"planta": plant} if plant else {})
    facts = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()]))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    rows = df.select(F.lit(1).alias("part"), F.to_json(F.struct(*df.columns)).alias("line"), F.lit(True).alias("item"), *keys)
    ends = df.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("part"), F.concat(F.rtrim(facts, F.lit("}")), F.lit(f',"{payload}":[')).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("line")))).alias("e"))
    rows = rows.unionByName(ends.select("e.*", F.lit(False).alias("item")), allowMissingColumns=True)
    path = "/".join([base.rstrip("/"), scenario, *([plant] if plant else []), name])
    write_lines(rows, [F.col("part"), *[F.col(f"_k{i}") for i in range(len(order))]], path, between=",\n")
    return path
