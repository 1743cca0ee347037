"""Proportional stratified interleaving into shards. DataFrame functions only.

Rows are shuffled within their source by a seeded digest, ranked there, and sorted by the fractional rank
(rank - 1/2) / rows of the source. In that order every stretch holds the sources in the proportions of the whole, so
cutting it into equal stretches gives shards that each match the mixture; their row counts differ by one at most.

No source is ranked in one task. A digest is a uniform number, so its high bits cut a source into even buckets; a bucket
is ranked on its own and the rows of the buckets before it are added. The global position is found the same way, over
buckets of the fractional rank. There are about as many buckets as rows in a bucket: both grow as the root of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siloway.llm.common import apart, hex_of, table, together, unit_of, written

SHARDS, SEED = 8, 7


def _starts(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """counts: (by, bucket, n). Adds ``start``, the rows in the buckets before. A line per bucket, not per row."""
    order = Window.partitionBy(*by).orderBy(bucket)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def interleave(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards - 1), ``slot`` (gapless from 0 in its shard) and ``fractional_rank``.

    All other columns stay; a column of ``df`` with one of those three names, or starting with ``_il_``, is replaced.
    A null source is a source of its own. Rows are ordered by their digest, then id, then source; rows equal in all
    three are ordered by the rest of their columns' hash, and rows equal in everything are interchangeable. An empty
    table gives an empty result.
    """
    df, back = apart(df, id_col, source_col, "shard", "slot", "fractional_rank")
    total = df.count()
    buckets = math.isqrt(total) + 1
    src, h = F.col("_il_src"), F.col("_il_hex")
    rows = df.drop("shard", "slot", "fractional_rank").withColumns(
        {
            "_il_src": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
            "_il_hex": hex_of(seed, id_col, source_col),
            "_il_tie": F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")]),
        }
    )
    rows = rows.withColumn("_il_b", F.floor(unit_of(h) * buckets).cast("int"))

    counts = rows.groupBy("_il_src", "_il_b").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.withColumn("_il_size", F.sum("n").over(Window.partitionBy("_il_src")))
    starts = _starts(sizes, ["_il_src"], "_il_b").select("_il_src", "_il_b", "_il_size", F.col("start").alias("_il_start"))
    within = Window.partitionBy("_il_src", "_il_b").orderBy(h, F.col(id_col), "_il_tie")
    ranked = (
        rows.withColumn("_il_rank", F.row_number().over(within))
        .join(starts, ["_il_src", "_il_b"])
        .withColumn("fractional_rank", (2 * (F.col("_il_start") + F.col("_il_rank")) - 1) / (2 * F.col("_il_size")).cast("double"))
        .withColumn("_il_b", F.floor(F.col("fractional_rank") * buckets).cast("int"))
        .drop("_il_rank", "_il_start", "_il_size")
    )
    ranked = written(ranked, "ranked")

    starts = _starts(ranked.groupBy("_il_b").agg(F.count(F.lit(1)).alias("n")), [], "_il_b").select("_il_b", F.col("start").alias("_il_start"))
    across = Window.partitionBy("_il_b").orderBy("fractional_rank", h, src, F.col(id_col), "_il_tie")
    place = F.col("_il_start") + F.col("_il_rank") - 1
    placed = (
        ranked.withColumn("_il_rank", F.row_number().over(across))
        .join(starts, "_il_b")
        .withColumn("_il_place", place.cast("long"))
        .withColumn("shard", F.expr(f"(_il_place * {shards}) div {max(total, 1)}").cast("int"))
        .withColumn("slot", F.expr(f"_il_place - (shard * {max(total, 1)}L + {shards - 1}) div {shards}").cast("long"))
        .drop("_il_src", "_il_hex", "_il_tie", "_il_b", "_il_start", "_il_rank", "_il_place")
    )
    return together(placed, back)


def write_shards(df: DataFrame, path: str) -> None:
    """Write interleaved rows, one folder per shard and one sorted file in each. Rows are written as they are, nulls, long
    texts and repeated rows included; an empty table gives an empty folder."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``; ``grown_shard`` is null, as that law has no growth."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave(docs).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "fractional_rank"
    )


SQL = {
    "op7_interleaved_shards": f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), docs AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''))) AS h
  FROM documents, crc_table
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fractional_rank FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fractional_rank, h, source, doc_id) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((place * {SHARDS}) // n)::INTEGER AS shard,
  (place - (((place * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, fractional_rank
FROM placed
""",
}
