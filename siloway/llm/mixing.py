"""Mixing sources to target weights by Poisson replication.

A source with target weight w among n of N rows gets the repetition rate ``epochs * w * N / n``. For each document a
uniform number comes from a hash of the seed and its id; inverting the Poisson distribution of that rate there gives its
number of copies, whose mean is the rate. Documents are exploded by their counts and the copies shuffled globally by a
second hash, through even ranges of it, so no step holds a source or the table in one task.

The table of distribution functions has one row per source and its arrays are as long as the largest count that a rate
can give with a probability that a double shows; counts are not capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, hex_of, table, together, unit_of

SEED, EPOCHS = 11, 1.0

#: Without given weights a source's target is its share of the rows to this power, scaled to a sum of 1.
TEMPERATURE = 0.7

#: Up to so many sources the table of rates is small enough to be broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the tail is below what a double can show.

    Probabilities are carried as logarithms, so large rates do not underflow to a sum of zero.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(rate / k)
        cdf = acc["cdf"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), cdf.alias("cdf"), F.concat(acc["all"], F.array(cdf)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]).otherwise(F.array(F.lit(1.0)))


def repetition_rates(
    df: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE
) -> DataFrame:
    """(source, n_rows, weight, rate): one row per source, null being a source like any other.

    ``weights`` need not sum to 1; a source that it lacks gets weight 0, and every weight must be finite and not
    negative.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        sizes = sizes.withColumn("raw", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        if not all(0 <= w < float("inf") for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = df.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()] or [("", 0.0)], "wanted string, raw double")
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("wanted")), "left").drop("wanted").fillna(0.0, ["raw"])
    # decimals add up to the same sum in any order
    total = sizes.agg(F.sum("n_rows").alias("n"), F.sum(F.col("raw").cast("decimal(30,12)")).cast("double").alias("raw")).first()
    n, raw = total["n"] or 0, total["raw"] or 1.0
    return sizes.withColumn("weight", F.col("raw") / F.lit(raw)).withColumn("rate", F.col("weight") * F.lit(float(epochs * n)) / F.col("n_rows")).drop("raw")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    epochs: float = EPOCHS,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with every row repeated by its Poisson count, in a global random order.

    Adds ``copy_no`` (from 0), ``n_copies`` and ``order_key`` (the digest that the rows are sorted by); columns of
    these names in ``df`` are replaced, all others stay. Rows with the same id and source get the same count. Null ids
    count as the empty text, null and empty texts are repeated like others, an empty table gives an empty result.
    """
    df, back = apart(df, id_col, source_col, "copy_no", "n_copies", "order_key")
    rates = repetition_rates(df, source_col, weights, epochs, temperature)
    src = free_name(df, "mix_source")
    cdf = free_name(df, "mix_cdf")
    rates = rates.select(F.col("source").alias(src), poisson_cdf(F.col("rate")).alias(cdf))
    small = rates.select(src).limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = df.drop("copy_no", "n_copies", "order_key")
    u = unit_of(hex_of(seed, id_col, source_col))
    mixed = (
        rows.join(F.broadcast(rates) if small else rates, F.col(source_col).eqNullSafe(F.col(src)))
        .withColumn("n_copies", F.size(F.filter(cdf, lambda p: p <= u)).cast("long"))
        .filter("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
        .withColumn("order_key", hex_of(f"{seed} order", id_col, source_col, "copy_no"))
        .drop(src, cdf)
    )
    # digests are even, so the bounds of the parts are known without a sample of the rows
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mixed.repartitionById(parts, F.floor(unit_of(F.col("order_key")) * parts).cast("int")).sortWithinPartitions("order_key")
    return together(mixed, back)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their tempered source weights: whole rows, repeated and shuffled."""
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = {
    "op1_mix_sources": f"""
WITH sizes AS (
  SELECT source AS src, count(*) AS n_rows, pow(count(*)::DOUBLE, {TEMPERATURE}) AS raw FROM documents GROUP BY source
), total AS (
  SELECT sum(n_rows)::DOUBLE AS n, sum(raw::DECIMAL(30,12))::DOUBLE AS raw FROM sizes
), rates AS (
  SELECT src, (sizes.raw / total.raw) * ({EPOCHS} * total.n) / n_rows AS rate FROM sizes, total
), terms AS (
  SELECT src, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate / k) END) OVER (PARTITION BY src ORDER BY k) AS log_p
  FROM rates, unnest(range((ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS t(k)
), cdf AS (
  SELECT src, k, sum(exp(log_p)) OVER (PARTITION BY src ORDER BY k) AS p FROM terms
), dist AS (
  SELECT src, list(p ORDER BY k) AS cdf FROM cdf GROUP BY src
), counted AS (
  SELECT d.*, len(list_filter(cdf, lambda p: p <= ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''))), 1, 13))::BIGINT / pow(16, 13))) AS n_copies
  FROM documents d JOIN dist ON d.source IS NOT DISTINCT FROM dist.src
), copies AS (
  SELECT *, unnest(range(n_copies)) AS copy_no FROM counted
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no,
  md5(concat_ws('|', '{SEED} order', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), copy_no::VARCHAR)) AS order_key
FROM copies
""",
}
