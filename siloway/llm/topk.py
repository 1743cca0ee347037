"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length. A bucket of similar lengths turns the score that a query must beat into a cosine that a
vector of the bucket must reach: threshold / (query length * longest length of the bucket). Above 1 the bucket and all
shorter ones are out. Below, every query prunes each bucket in the cheaper of two ways. By length, the vectors long enough
for the threshold are multiplied in full. By coordinates, they are first multiplied at the query's strongest coordinates
only; what is left of both vectors adds at most the product of its lengths, and only vectors that can still reach the
threshold are multiplied in full. The local cosine tells how many that will be, and so which way takes fewer products.
What is left is verified by the exact integer product.

A first pass over one block of candidates gives every query a score that its k-th best cannot be under. The second pass is
a grid of blocks of queries and blocks of candidates of one class of lengths; cells whose vectors are too short for all
queries of the block are not made. Blocks within a class are even by hash, each cell returns at most k rows per query, and
a last aggregation merges cells. No query, bucket or copy gathers more rows than others do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siloway.llm.common import table, written

K, QUERY_EVERY, SCALE = 20, 20, 64

#: Rows of a block of candidates and of a block of queries, vectors of a norm bucket within a block, queries at once.
CANDIDATE_ROWS, QUERY_ROWS, BUCKET_ROWS, QUERY_STEP = 16_384, 4_096, 2_048, 512

#: Classes of lengths of candidates in a doubling of the squared length.
CLASSES = 8

#: The share of a vector's coordinates that coordinate pruning looks at.
STRONGEST = 0.5


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def survivors(cosine: np.ndarray, kept: np.ndarray, size: int, width: int) -> np.ndarray:
    """The share of a bucket that coordinate pruning is expected to leave, from local cosines and the share ``kept`` of the
    squared query in its ``width`` strongest of ``size`` coordinates, as if directions were random."""
    rest = np.sqrt(np.maximum(0.0, 1 - kept) * (1 - width / size))
    spread = np.sqrt(np.maximum(kept, 1e-12) / size)
    z = np.clip((cosine - rest) / spread, -8, 8)
    return 1 / (1 + np.exp(1.702 * z))  # close to the normal tail


def block_top_k(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K, own: np.ndarray | None = None, floor: np.ndarray | None = None, tally: dict | None = None
) -> pd.DataFrame:
    """The k best candidates of each query in one block: rows (query_id, vec_id, score), of those that reach ``floor``.

    A query is not its own candidate: ``own`` is the place of its own row among the candidates, -1 for none; without it
    candidates of the query's id are left out. ``tally`` counts rows left out by length and by coordinates, and buckets
    by the way that they were pruned.
    """
    empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
    if not len(ids) or not len(query_ids):
        return empty
    tally = {} if tally is None else tally
    slack = 1e-9
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order].astype(float), lengths[order]
    squares = vectors**2
    place_of = np.empty(len(ids), np.int64)
    place_of[order] = np.arange(len(ids))
    own_place = None if own is None else np.where(own >= 0, place_of[own], -1)
    queries = queries.astype(float)
    n, size = queries.shape
    q_length = np.sqrt((queries**2).sum(1))
    width = max(1, int(size * STRONGEST))
    strongest = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :width]
    q_strong = np.take_along_axis(queries, strongest, axis=1)
    q_rest = np.sqrt(np.maximum(0.0, q_length**2 - (q_strong**2).sum(1)))
    kept = np.where(q_length > 0, (q_strong**2).sum(1) / np.maximum(q_length, 1e-300) ** 2, 1.0)
    best_score, best_id = [np.empty(0)] * n, [np.empty(0, np.int64)] * n
    threshold = np.full(n, -np.inf) if floor is None else floor.astype(float).copy()  # what a score must reach

    def take(q: int, at: np.ndarray, scores: np.ndarray) -> None:
        other = ids[at] != query_ids[q] if own_place is None else at != own_place[q]
        all_ids, all_scores = np.concatenate([best_id[q], ids[at[other]]]), np.concatenate([best_score[q], scores[other]])
        top = np.lexsort((all_ids, -all_scores))[:k]
        best_id[q], best_score[q] = all_ids[top], all_scores[top]
        if len(top) == k:
            threshold[q] = max(threshold[q], all_scores[top[-1]])

    for start in range(0, len(ids), BUCKET_ROWS):
        b, b_len, b_squares = vectors[start : start + BUCKET_ROWS], lengths[start : start + BUCKET_ROWS], squares[start : start + BUCKET_ROWS]
        reach = q_length * b_len[0]
        live = np.flatnonzero((reach * (1 + slack) >= threshold) | (threshold <= 0))
        if not len(live):
            tally["by_length"] = tally.get("by_length", 0) + n * (len(ids) - start)
            break  # every later bucket is shorter
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((reach[live] > 0) & (threshold[live] > 0), threshold[live] / reach[live], -1.0)
            need = np.where(threshold[live] > 0, threshold[live] / q_length[live], 0.0)
        long_enough = np.searchsorted(-b_len, -(need * (1 - slack)), "right")
        tally["by_length"] = tally.get("by_length", 0) + (n - len(live)) * len(b) + int((len(b) - long_enough).sum())
        coordinates = (cosine > 0) & (width / size + survivors(cosine, kept[live], size, width) < 1)
        tally["length_buckets"] = tally.get("length_buckets", 0) + int((~coordinates).sum())
        tally["coordinate_buckets"] = tally.get("coordinate_buckets", 0) + int(coordinates.sum())
        dense, rows_of = live[~coordinates], long_enough[~coordinates]
        for step in range(0, len(dense), QUERY_STEP):
            part, upto = dense[step : step + QUERY_STEP], rows_of[step : step + QUERY_STEP]
            scores = queries[part] @ b[: upto.max(initial=0)].T
            for row, q in enumerate(part):
                found = np.flatnonzero(scores[row, : upto[row]] >= threshold[q])
                if len(found):
                    take(q, start + found, scores[row][found])
        for q, upto in zip(live[coordinates], long_enough[coordinates], strict=True):
            columns = strongest[q]
            partial = b[:upto].take(columns, axis=1) @ q_strong[q]
            rest = b_len[:upto] ** 2 - b_squares[:upto].take(columns, axis=1).sum(1)
            found = np.flatnonzero(partial + q_rest[q] * np.sqrt(np.maximum(rest, 0.0)) * (1 + slack) + 1e-6 >= threshold[q])
            tally["by_coordinates"] = tally.get("by_coordinates", 0) + int(upto) - len(found)
            scores = b[found] @ queries[q]
            enough = scores >= threshold[q]
            if enough.any():
                take(q, start + found[enough], scores[enough])
    counts = [len(x) for x in best_id]
    return pd.DataFrame(
        {"query_id": np.repeat(query_ids, counts), "vec_id": np.concatenate(best_id).astype(np.int64), "score": np.rint(np.concatenate(best_score)).astype(np.int64)}
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): every query's k highest integer products, ties to the smaller vec_id.

    Both inputs are (vec_id, vector array<long>). A query is not a candidate of itself; fewer candidates than k give all
    of them. Rows equal in id and vector are one row. Rows of one id with different vectors are rows of their own: each
    is a candidate, also of the others, and each is a query with its own k results; ``query_row`` numbers them from 1 in
    the order of their vectors, and is 1 throughout where ids are distinct. Of vectors of different sizes the shorter one's
    missing components count as 0; empty vectors score 0. Empty inputs give an empty result.
    """
    n_candidates, n_queries = candidates.count(), queries.count()
    across, down = max(1, -(-n_candidates // candidate_rows)), max(1, -(-n_queries // query_rows))
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))

    def salted(blocks: Column | int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")

    numbered = queries.select("vec_id", "vector", F.dense_rank().over(Window.partitionBy("vec_id").orderBy("vector")).alias("query_row"))
    asked = numbered.withColumn("q_block", salted(down)).withColumn("q_length", F.sqrt(squared))
    first = candidates.filter(salted(across) == 0)
    lowest = F.lit(float("-inf"))
    seeds = _searched(asked.withColumn("cell", F.col("q_block")).withColumn("floor", lowest), first.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))), k)
    floors = seeds.groupBy("query_id", "query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    floors = floors.select(F.col("query_id").alias("vec_id"), "query_row", F.col("floor").cast("double").alias("floor"))
    asked = written(asked.join(floors, ["vec_id", "query_row"], "left").withColumn("floor", F.coalesce("floor", lowest)), "queries")

    # blocks of candidates are of one class of lengths
    kind = F.when(squared > 0, F.floor(F.log2(squared) * CLASSES)).otherwise(-1).cast("long")
    classed = candidates.withColumn("kind", kind).withColumn("c_length", F.sqrt(squared))
    kinds = classed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("c_length").alias("longest"))
    kinds = kinds.select("kind", "longest", F.ceil(F.col("n") / candidate_rows).cast("int").alias("blocks"))
    # there are at most CLASSES of them in a doubling of squared lengths, whatever the rows
    placed = classed.join(F.broadcast(kinds.select("kind", "blocks")), "kind").withColumn("c_block", salted(F.col("blocks")))
    # what a vector must be long for some query of a block to need it
    reach = F.when((F.col("floor") <= 0) | (F.col("q_length") == 0), 0.0).otherwise(F.col("floor") / F.col("q_length") * (1 - 1e-9))
    cells = asked.groupBy("q_block").agg(F.min(reach).alias("need")).crossJoin(F.broadcast(kinds)).filter("longest >= need")
    cells = cells.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.xxhash64("q_block", "kind", "c_block")).select("q_block", "kind", "c_block", "cell")
    q = asked.join(cells.select("q_block", "cell"), "q_block")
    c = placed.join(cells.select("kind", "c_block", "cell"), ["kind", "c_block"])
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return _searched(q, c, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def _searched(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, vec_id, score): the k best of every cell for queries (cell, vec_id, query_row, vector, floor) among
    candidates (cell, vec_id, vector)."""

    def key(vector: np.ndarray) -> bytes:
        return np.asarray(vector, np.int64).tobytes()

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype=np.int64)
        left, right = left.drop_duplicates(["vec_id", "query_row"]), right.set_axis(["cell", "vec_id", "vector"], axis=1)
        if right["vec_id"].duplicated().any():  # equal rows hash to the same block
            right = right[~pd.Series([*zip(right["vec_id"], map(key, right["vector"]))], index=right.index, dtype=object).duplicated()]
        size = max([1, *map(len, left["vector"]), *map(len, right["vector"])])

        def matrix(rows: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(rows), size))
            for i, v in enumerate(rows["vector"]):
                out[i, : len(v)] = v
            return out

        query_ids, query_rows, ids = left["vec_id"].to_numpy(np.int64), left["query_row"].to_numpy(np.int32), right["vec_id"].to_numpy(np.int64)
        asked = np.flatnonzero(np.isin(ids, query_ids))
        place = {(ids[i], key(v)): i for i, v in zip(asked, right["vector"].iloc[asked], strict=True)}
        own = np.array([place.get((i, key(v)), -1) for i, v in zip(query_ids, left["vector"], strict=True)], np.int64)
        found = block_top_k(np.arange(len(left)), matrix(left), ids, matrix(right), k, own, left["floor"].to_numpy(float))
        at = found["query_id"].to_numpy(np.int64)
        return found.assign(query_id=query_ids[at], query_row=query_rows[at])

    # both sides come from one table; under names of their own their columns are not mixed up when plans are pruned
    q = queries.select("cell", "vec_id", "query_row", "vector", "floor")
    c = candidates.select(F.col("cell").alias("c_cell"), F.col("vec_id").alias("c_id"), F.col("vector").alias("c_vector"))
    return q.groupBy("cell").cogroup(c.groupBy("c_cell")).applyInPandas(search, "query_id long, query_row int, vec_id long, score long")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring vectors of every query vector (vec_id divisible by 20) among all other vectors."""
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector")), "vectors")
    return top_k(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), vectors).select("query_id", "rank", "vec_id", "score")


SQL = {
    "op4_topk": f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
""",
}
