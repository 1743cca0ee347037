"""Exact de-duplication by a tree merge of digest runs. DataFrame functions only.

Every row is hashed to one of ``runs`` runs. Digests of a run are sorted and equal ones become one entry, which keeps the
id to retain and the number of rows. Runs are then exchanged in binomial rounds of ``fan_in`` partners: in round k, run r
takes the runs r + i * fan_in ** k and merges them in the order of their digests, so equal entries meet and one stays at
every level. After the last round one run is left, whose entries are the classes of equal texts. Runs are cut at the same
prefixes of digests (``SLICE_BITS``), so that even the last merge is as many tasks as the cluster has. A class holding a
third of all rows is one entry per run after the first level, so no later task sees its rows. The merges are Spark's sort
aggregations: an exchange by (slice, run), a sort by digest, one pass over neighbours.

Entries are equal when SHA-256, length in bytes and a second, unrelated 64-bit hash all agree; a differing length or
second hash would keep two texts apart even if their SHA-256 collided. The texts themselves are not compared.

The way back uses the same tree: class -> entry of each run -> rows of that run, so the join that reaches the rows is
keyed by (run, digest) and a hot class is spread over all runs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, table, together, written

#: Runs at the leaves of the tree, how many runs one merge takes, and bits of the digest by which runs are cut in slices.
RUNS, FAN_IN, SLICE_BITS = 256, 4, 16

KEY = ["digest", "n_bytes", "check_hash"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """(id, run, digest, n_bytes, check_hash) of every row."""
    df, _ = apart(df, id_col, text_col)
    norm = ascii_lower(F.col(text_col))
    return df.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id",
        F.pmod(F.xxhash64(F.col("id")), F.lit(runs)).cast("int").alias("run"),
        F.sha2("norm", 256).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check_hash"),
    )


def merged(entries: DataFrame, keep: str) -> DataFrame:
    """Neighbours with equal digests in sorted runs (slice, run, ..., best, group_size) as one entry.

    ``best`` is (whether the id counts for nothing or for more, id), so a null id only stays among null ids. Being a struct
    it has Spark aggregate by sorting.
    """
    best = {"max": F.max, "min": F.min}[keep]
    return entries.groupBy("slice", "run", *KEY).agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))


def leaf_entries(rows: DataFrame, keep: str = "max") -> DataFrame:
    """The entries of every run: (slice, run, digest, n_bytes, check_hash, best, group_size) of rows of ``digest_rows``."""
    first = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    cut = F.conv(F.substring("digest", 1, SLICE_BITS // 4), 16, 10).cast("int")
    return merged(rows.select(cut.alias("slice"), "run", *KEY, F.struct(first.alias("rank"), "id").alias("best"), F.lit(1).cast("long").alias("group_size")), keep)


def merge_runs(entries: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge leaf entries round by round into one run: (digest, n_bytes, check_hash, keep_id, group_size)."""
    reach = 1
    while reach < runs:
        reach *= fan_in
        partner = F.floor(F.col("run") / reach).cast("int") * reach
        entries = merged(entries.withColumn("run", partner).repartition("slice", "run"), keep)
    return entries.select(*KEY, F.col("best.id").alias("keep_id"), "group_size")


def duplicate_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Null texts and empty texts are one class. Repeated rows (the same id and text twice) are two rows of a class; both
    have ``kept`` true when theirs is the retained id. A null id sorts below all others and is retained only in a class
    of null ids, where ``kept`` is true. Columns of ``df`` besides id and text are not read. An empty table gives an
    empty result.
    """
    rows = written(digest_rows(df, id_col, text_col, runs), "digests")
    leaves = leaf_entries(rows, keep)
    classes = merge_runs(leaves, keep, runs, fan_in)
    shared = classes.filter("group_size > 1").select(*KEY, "keep_id", "group_size")
    down = leaves.select("run", *KEY).join(shared, KEY)
    return rows.join(down, ["run", *KEY], "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, extra ones included.

    A row goes only if its own id and text were dropped, so an id that also has another text keeps that. Rows that
    repeat a retained id with an equal text are the same row to this operator and all stay with it.
    """
    df, back = apart(df, id_col, text_col)
    mark, digest = free_name(df, "dropped_id"), free_name(df, "dropped_digest")
    dropped = duplicate_classes(df, id_col, text_col, keep, runs, fan_in).filter("not kept")
    dropped = dropped.select(F.col("id").alias(mark), F.col("text_sha256").alias(digest)).distinct()
    same = df[id_col].eqNullSafe(dropped[mark]) & (F.sha2(ascii_lower(df[text_col]), 256) == dropped[digest])
    return together(df.join(dropped, same, "left_anti"), back)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays of its class of equal texts, and the size of the class."""
    return duplicate_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = {
    "op9_exact_dedup": f"""
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents
), grouped AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
""",
}
