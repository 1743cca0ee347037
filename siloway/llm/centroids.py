"""Centroid clustering of integer vectors by Lloyd rounds with Hamerly's bounds.

Every vector carries, from round to round, its cluster, an upper bound of its distance to that centroid and one lower bound
of its distance to any other. When centroids move, the upper bound grows by the drift of the vector's own centroid and the
lower one shrinks by the largest drift of the others. A vector whose upper bound is under its lower one, or under half the
way from its centroid to the next, stays without being looked at. For the rest the distance to their own centroid is
worked out first, and where that does not settle it, all distances are, in whole numbers, ties to the smaller number.
Bounds are doubles, widened by more than their rounding, and have to be strictly apart, so ties are always scanned.

A round reads the rows that the last one wrote and writes them with new bounds; vectors are packed as bytes, four a component, which
Spark moves without looking into them. Sums by cluster are made within tasks, and Spark adds up a row per task and cluster.
Only centroids, of which there are k, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, emptied, new_path, stored, table, written
from siloway.llm.topk import usable

#: Clusters, rounds, components of a vector, what a component is multiplied by, and the seed of the first centroids.
K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3

#: Largest whole component: squared distances of vectors of up to 64 of them fit 64 bits.
LARGEST = 2**27

#: How much bounds are widened by, as a share, and what doubles hold exactly.
SLACK, EXACT = 1e-9, 2**53

STATE = "vec_id long, v binary, cluster int, upper double, lower double"


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def unpacked(column: pa.Array, kind: type = np.int32) -> np.ndarray:
    """A binary column of equal lengths, without nulls, as rows of numbers."""
    if not len(column):
        return np.zeros((0, 0), kind)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def quantised_rows(rows: DataFrame, scale: int, largest: int = LARGEST) -> DataFrame:
    """``rows`` whose last column is a usable vector of doubles, with floor(scale * x) of its components packed as ``v``; fails where one
    is beyond ``largest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            x = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            if np.abs(x).max(initial=0) > largest:
                raise ValueError(f"a component times {scale} is beyond {largest}")
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32) * 4
            v = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(x.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], v], [*batch.schema.names[:-1], "v"])

    kept = [(c, t) for c, t in rows.dtypes[:-1]]
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kept) + ", v binary")


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of ``v`` by centroids), as int64."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * top * top * v.shape[1] < EXACT:
        x, c = v.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x = v.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds of the way that each centroid has moved."""
    moved = (old - new).astype(float)
    return np.sqrt((moved * moved).sum(1)) * (1 + SLACK)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, bounds of the distance to it and to the second nearest) by whole distances."""
    d = squared(v, centroids)
    best = d.argmin(1)
    at = np.arange(len(d))
    upper = np.sqrt(d[at, best].astype(float)) * (1 + SLACK)
    d[at, best] = np.iinfo(np.int64).max
    return best.astype(np.int32), upper, np.sqrt(d.min(1, initial=np.iinfo(np.int64).max).astype(float)) * (1 - SLACK)


def reassigned(
    v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, tally: dict | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) for centroids that have moved by ``drift``. ``tally`` counts vectors settled by bounds, by
    the distance to their own centroid, and by a full scan."""
    k = len(centroids)
    others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(k)])
    between = np.sqrt(squared(centroids, centroids).astype(float))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2 * (1 - SLACK)
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = lower - others[cluster]
    lower = lower - np.abs(lower) * SLACK
    safe = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(upper >= safe)
    own = v[open_].astype(np.int64) - centroids[cluster[open_]]
    upper[open_] = np.sqrt((own * own).sum(1).astype(float)) * (1 + SLACK)
    unclear = open_[upper[open_] >= safe[open_]]
    cluster = cluster.copy()
    cluster[unclear], upper[unclear], lower[unclear] = scan(v[unclear], centroids)
    if tally is not None:
        for name, n in (("kept", len(v) - len(open_)), ("own", len(open_) - len(unclear)), ("scanned", len(unclear))):
            tally[name] = tally.get(name, 0) + n
    return cluster, upper, lower


def assigned(df: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The rows of ``df`` with the cluster and bounds of the new centroids; without ``drift`` it is the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unpacked(batch.column(1))
            if drift is None:
                state = scan(v, centroids)
            else:
                state = reassigned(v, *[batch.column(i).to_numpy() for i in (2, 3, 4)], centroids, drift)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, state)], ["vec_id", "v", "cluster", "upper", "lower"])

    return df.mapInArrow(run, STATE)


def summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], groups: int, width: int) -> pa.RecordBatch:
    """(group, n, s): rows and componentwise sums of each group over batches of (rows, their groups); groups without rows are left out."""
    sums, counts = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64)
    for rows, group in batches:
        order = np.argsort(group, kind="stable")
        some, first = np.unique(group[order], return_index=True)
        if len(some):
            sums[some] += np.add.reduceat(rows[order].astype(np.int64), first, axis=0)
        counts += np.bincount(group, minlength=groups)
    some = np.flatnonzero(counts)
    ends = pa.array(np.arange(0, (len(some) + 1) * width, width, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.ListArray.from_arrays(ends, pa.array(sums[some].reshape(-1)))], ["group", "n", "s"])


def floor_means(partial: DataFrame, before: np.ndarray) -> np.ndarray:
    """``before`` (groups by components) with the floors of the means of groups that have rows. ``partial`` is (group, n, s) of tasks."""
    width = before.shape[1]
    added = partial.groupBy("group").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    after = before.copy()
    for row in added.collect():  # a row per group
        after[row["group"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def moved(df: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """New centroids: the floor of the mean of each component over a cluster's rows; a cluster without rows keeps its own."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield summed(((unpacked(b.column(0)), b.column(1).to_numpy()) for b in batches if b.num_rows), k, size)

    return floor_means(df.select("v", "cluster").mapInArrow(run, "group long, n long, s array<long>"), centroids)


def distances(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the exact squared distance to a row's own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = unpacked(batch.column(1)).astype(np.int64) - centroids[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((away * away).sum(1))], ["vec_id", "cluster", "distance"])

    return df.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable row, the final centroids).

    Rows whose vector is null, has another number of components than ``size``, or holds null or non-finite ones take no
    part; a component whose whole number is beyond 2**27 fails the job. The first centroids are the k rows with the
    smallest sha256 of ``seed:id``, fewer if there are fewer rows; equal ids are told apart by their vectors' bytes. Rows that
    repeat an id are rows of their own; a null id is digested as empty text. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    df, _ = apart(df, id_col, vector_col)
    vector = F.col(vector_col)
    rows = df.filter(usable(vector) & (F.size(vector) == size)).select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    path = new_path(df.sparkSession, "vectors")
    rows = stored(quantised_rows(rows, scale), path)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    if not first:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, size), np.int64)
    centroids = np.array([np.frombuffer(r["v"], np.int32) for r in first], np.int64)
    state, drift = rows, None
    for _ in range(rounds):
        last, path = path, new_path(df.sparkSession, "bounds")
        before, state = state, stored(assigned(state, centroids, drift), path)
        emptied(before, last)
        after = moved(state, centroids)
        centroids, drift = after, drifts(centroids, after)
    found = written(distances(assigned(state, centroids, drift), centroids), "clusters")
    emptied(state, path)
    return found, centroids


def digest_of(numbers: np.ndarray) -> str:
    """sha256 in hex of whole numbers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, numbers.reshape(-1).tolist())).encode()).hexdigest()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds, with inertia of the cluster and of all and a digest of its centroid."""
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per cluster
    total = sum(r["cluster_inertia"] for r in by_cluster)
    rows = [(r["cluster"], r["cluster_inertia"], total, digest_of(centroids[r["cluster"]])) for r in by_cluster]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)"""
        )
        if r < rounds:
            parts.append(
                f"""u{r} AS (SELECT c, unnest(v) AS x, unnest(range(1, {size + 1})) AS i FROM a{r}), s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM u{r} GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY c
  ) n USING (c)
)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""
    )


SQL = {"op13_centroids": _sql()}
