"""Vector codes: one codebook per part of a vector, fitted by Lloyd rounds with Elkan's bounds, on whole numbers.

Every vector carries for each part its entry, an upper bound of the distance to it and one lower bound per entry of the
codebook. When entries move, upper bounds grow and lower bounds shrink by the way of the entry they are of. An entry whose
lower bound, or half of whose distance from the part's own entry, is strictly above the upper bound cannot be nearest or
tie; the distance to the own entry is worked out if any entry is left, and then those to the entries still left, in whole
numbers, ties to the lower index. Bounds are widened by more than their rounding. A lower bound is kept in a byte, as a
multiple, rounded down, of a step per vector and part: 1 KB a vector for 16 codebooks of 64.

A round reads the rows that the last one wrote and writes them with new bounds, then a second pass over entries and vectors
sums them within tasks before Spark adds the sums up. Only codebooks pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.centroids import SLACK, digest_of, drifts, floor_means, packed, quantised_rows, squared, summed, unpacked
from siloway.llm.common import apart, emptied, new_path, stored, table, written
from siloway.llm.topk import usable

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Largest whole component: a squared distance times the number of entries fits 64 bits.
LARGEST = 2**24

#: Steps of a lower bound, parts that rows of one label are dealt to, and rows that a task works off at once.
STEPS, RUNS, CHUNK = 255, 64, 2048

STATE = "vec_id long, label string, v binary, codes binary, upper binary, lower binary, step binary"


def stepped(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, step) of lower bounds by row (vectors by entries): byte * step is at most the bound."""
    lower = np.maximum(lower, 0.0)
    step = lower.max(1) / STEPS
    shown = np.divide(lower, step[:, None], out=np.zeros_like(lower), where=step[:, None] > 0)
    return np.floor(shown * (1 - SLACK)).clip(0, STEPS).astype(np.uint8), step


def first_codes(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of parts by all whole distances."""
    d = squared(x, book)
    code = d.argmin(1)
    return code, np.sqrt(d[np.arange(len(d)), code].astype(float)) * (1 + SLACK), np.sqrt(d.astype(float)) * (1 - SLACK)


def next_codes(
    x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, drift: np.ndarray, tally: dict | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of parts for a codebook whose entries moved by ``drift``. ``tally`` counts distances
    worked out and left out."""
    k, at = len(book), np.arange(len(x))
    between = np.sqrt(squared(book, book).astype(float)) / 2 * (1 - SLACK)
    np.fill_diagonal(between, np.inf)
    upper = (upper + drift[code]) * (1 + SLACK)
    lower = np.maximum(lower - drift, 0.0) * (1 - SLACK)
    lower[at, code] = np.inf  # the own entry is not one to go to
    bound = np.maximum(lower, between[code])
    near = np.flatnonzero(upper >= bound.min(1))
    own = ((x[near] - book[code[near]]) ** 2).sum(1)
    upper[near] = np.sqrt(own.astype(float)) * (1 + SLACK)
    row, entry = np.nonzero(upper[near, None] >= bound[near])
    away = ((x[near[row]] - book[entry]) ** 2).sum(1)
    best = own * k + code[near]
    np.minimum.at(best, row, away * k + entry)
    lower[near[row], entry] = np.sqrt(away.astype(float)) * (1 - SLACK)
    lower[near, code[near]] = np.sqrt(own.astype(float)) * (1 - SLACK)
    lower[at, code] = np.where(np.isinf(lower[at, code]), 0.0, lower[at, code])
    code = code.copy()
    code[near] = best % k
    upper[near] = np.sqrt((best // k).astype(float)) * (1 + SLACK)
    if tally is not None:
        done = len(near) + len(row)
        tally["done"], tally["left out"] = tally.get("done", 0) + done, tally.get("left out", 0) + len(x) * k - done
    return code, upper, lower


def coded(df: DataFrame, books: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The rows of ``df`` with entries and bounds for the new codebooks (parts by entries by components); the first round has
    no ``drift``."""
    parts, k, width = books.shape

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        v = unpacked(batch.column(2)).astype(np.int64).reshape(n, parts, width)
        codes, upper, step = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts))
        lower = np.zeros((n, parts, k), np.uint8)
        if drift is not None:
            old_codes = unpacked(batch.column(3), np.uint8)
            old_upper, old_step = unpacked(batch.column(4), np.float64), unpacked(batch.column(6), np.float64)
            old_lower = unpacked(batch.column(5), np.uint8).reshape(n, parts, k)
        for p in range(parts):
            if drift is None:
                code, up, low = first_codes(v[:, p], books[p])
            else:
                code, up, low = next_codes(v[:, p], old_codes[:, p].astype(np.int64), old_upper[:, p], old_lower[:, p] * old_step[:, p, None], books[p], drift[p])
            codes[:, p], upper[:, p] = code, up
            lower[:, p], step[:, p] = stepped(low)
        state = [packed(codes), packed(upper), packed(lower.reshape(n, parts * k)), packed(step)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *state], ["vec_id", "label", "v", "codes", "upper", "lower", "step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                yield one(batch.slice(start, CHUNK))

    return df.mapInArrow(run, STATE)


def moved(df: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: the floor of the mean of each component over an entry's parts; an entry without parts keeps its own."""
    parts, k, width = books.shape

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        codes = unpacked(batch.column(1), np.uint8)
        return unpacked(batch.column(0)).reshape(-1, width), (codes + np.arange(parts) * k).reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield summed((rows(b) for b in batches if b.num_rows), parts * k, width)

    partial = df.select("v", "codes").mapInArrow(run, "group long, n long, s array<long>")
    return floor_means(partial, books.reshape(parts * k, width)).reshape(books.shape)


def errors(df: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the entries in hex and the exact squared distance to them, summed over parts."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, codes = unpacked(batch.column(2)).astype(np.int64).reshape(-1, parts, width), unpacked(batch.column(3), np.uint8)
            away = v - books[np.arange(parts), codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array((away * away).sum((1, 2)))], ["vec_id", "label", "code", "error"])

    return df.select("vec_id", "label", "v", "codes").mapInArrow(run, "vec_id long, label string, code string, error long")


def encode_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label as text, code, error) of every usable row, the final codebooks: parts by entries by components).

    Rows whose vector is null or holds null or non-finite components take no part. The vector of the smallest id that is
    not empty and can be cut into ``parts`` sets the number of components; rows with another number take no part. A
    component whose whole number is beyond 2**24 fails the job. Codebooks start with the parts of the ``entries`` rows of
    smallest id, equal ids told apart by their vectors' bytes, null ids last; with fewer rows they are smaller. Rows that repeat an
    id are rows of their own. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    df, _ = apart(df, id_col, vector_col, *([label_col] if label_col else []))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    vector = F.col(vector_col)
    rows = df.filter(usable(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
    lead = rows.select("vec_id", F.size("vector").alias("size")).orderBy(F.col("vec_id").asc_nulls_last(), "size").limit(1).collect()
    if not lead:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    size = lead[0]["size"]
    path = new_path(spark, "vectors")
    state = stored(quantised_rows(rows.filter(F.size("vector") == size), scale, LARGEST), path)
    first = np.array([np.frombuffer(r["v"], np.int32) for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    books, drift = np.ascontiguousarray(first.reshape(len(first), parts, size // parts).swapaxes(0, 1)), None
    for _ in range(rounds):
        last, path = path, new_path(spark, "bounds")
        before, state = state, stored(coded(state, books, drift), path)
        emptied(before, last)
        after = moved(state, books)
        books, drift = after, np.stack([drifts(b, a) for b, a in zip(books, after, strict=True)])
    found = written(errors(coded(state, books, drift), books), "codes")
    emptied(state, path)
    return found, books


def total_by(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over equal ``by``, nulls together. Rows of one ``by`` meet its sum in runs, not in one task."""
    run = F.pmod(F.xxhash64("vec_id"), F.lit(RUNS)).alias("_run")
    rows = df.select("*", run, F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit("")).alias("_by"))
    by_run = rows.groupBy("_by", "_run").agg(F.sum(value).alias("part"))
    totals = by_run.groupBy("_by").agg(F.sum("part").alias(name))
    return rows.join(by_run.select("_by", "_run").join(totals, "_by"), ["_by", "_run"]).drop("_by", "_run")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and squared error after two rounds, the error of its label, and a digest of the codebooks."""
    found, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    out = total_by(found, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""cut AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)
)""",
        f"""c0 AS MATERIALIZED (
  SELECT p, e, x AS m FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})) USING (vec_id)
)""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best FROM cut JOIN c{r} USING (p) GROUP BY vec_id, p, x
)"""
        )
        if r < rounds:
            steps.append(
                f"""u{r} AS (SELECT p, best.e AS e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{r}), s{r} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM u{r} GROUP BY p, e, i),
c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY p, e
  ) n USING (p, e)
)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
books AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), books"""
    )


SQL = {"op12_vector_codes": _sql()}
