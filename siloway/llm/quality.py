"""Quality classifier by Bradley-Terry ranking of preference pairs.

A document's strength is a linear function of features of its whole text. From pairs (better, worse) of labelled
documents the weights are learned by logistic loss on feature differences: the model of Bradley and Terry, in which the
probability that one document beats another is the logistic of the difference of their strengths. Pairs are labelled
training rows of either label, matched by hash. The threshold is the quantile of the training strengths that leaves the
share of documents labelled 0 below it, moved to the middle of the gap there; scores are the logistic of the strength
over that threshold, shifted so that the threshold falls on ``CUT``.

Training takes every labelled row outside the held-out fifth, a few dozen numbers each. Tasks turn texts into features;
rows are shuffled by hash into groups of about ``GROUP_ROWS``, within which they meet, and each group is packed into one
row. A step of Newton's method is a pass over the groups in which every task sums the slope and curvature of its pairs;
only those sums reach the driver. The threshold is found among the strengths of all training rows, ranked in Spark.
Scoring reads every whole text once, in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, hex_of, small_batches, table, together, unit_of, written

#: Rows that ``labelled_sample`` takes at most (no model of this module), pairs that each training row makes, the seed of both.
SAMPLE_ROWS, PAIRS_EACH, SEED = 20_000, 8, 5

#: Training rows of a group, about, and rows of the scarcer label that a group holds at least, about: where there are too
#: few for that, each of them is in several groups and counts for a part in each.
GROUP_ROWS, MIN_SCARCE = 1024, 64

#: Ranges of strengths that rows are ranked in.
BINS = 4096

#: Where the threshold between rejected and kept falls on the scale of scores.
CUT = 0.3

#: Weight of the squared weights against the mean loss.
RIDGE = 1e-3

_B = np.arange(256)
CLASSES = np.zeros((256, 9))
for _k, _set in enumerate(
    (
        (_B >= 97) & (_B <= 122),
        (_B >= 65) & (_B <= 90),
        (_B >= 48) & (_B <= 57),
        _B >= 128,
        (_B == 32) | (_B == 9),
        (_B == 10) | (_B == 13),
        np.isin(_B, [*b".,;:'\"-()"]),
        np.isin(_B, [*b"!?"]),
        np.isin(_B, [*b"#$%&*+/<=>@[\\]^_`{|}~"]),
    )
):
    CLASSES[_set, _k] = 1

FEATURES = [
    "lower", "upper", "digit", "non_ascii", "space", "newline", "plain_punct", "loud_punct", "symbol", "bar", "log_words", "word_chars", "distinct", "repeated", "top_word", "top_line", "log_lines", "longest",
]


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; null counts as the empty text. All are bounded or logarithms."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ CLASSES / max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    most = max(distinct.values(), default=0)
    return [
        *shares.tolist(),
        counts[124] / max(1, len(data)),
        np.log1p(len(words)),
        min(len(data) / n, 100.0) / 10,
        len(distinct) / n,
        same / n,
        most / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(max(map(len, distinct), default=0)),
    ]


def _add_features(df: DataFrame, text_col: str, name: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch.tolist()], dtype=object)

    return df.withColumn(name, compute(text_col))


def held_out(id_col: str = "doc_id"):
    """Whether a row is of the fifth that no model learns from."""
    return (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, label) of the labelled training rows with the lowest hashes, ``rows`` at most.

    For callers that need the texts of a bounded number of rows; ``train`` takes ``labelled_features``. The chosen ids are
    bounded by ``rows`` and so may be broadcast; documents are read once and not shuffled. Of rows that repeat an id the
    greatest text is taken, of labels the greatest; null ids and null labels take no part.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .withColumn("h", hex_of(seed, "doc_id"))
        .orderBy("h")
        .limit(rows)
        .drop("h")
    )
    docs, _ = apart(docs, "doc_id", "text")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, x) of all labelled training rows: every label meets the features of its whole text.

    Texts are read once and not shuffled. Of rows that repeat an id the greatest features are taken, of labels the greatest;
    null ids and null labels take no part.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    docs, _ = apart(docs, "doc_id", "text")
    docs = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    found = _add_features(docs, "text", "x").groupBy("doc_id").agg(F.max("x").alias("x"))
    return known.join(found, "doc_id").select("doc_id", "label", "x")


def grouped(rows: DataFrame, n_good: int, n_bad: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row of ``rows`` (doc_id, label, x) in a group by hash: group, h, label, x, share and first.

    Copies of a row of the scarcer label share its weight (``share``); ``first`` marks one of them.
    """
    groups = -(-(n_good + n_bad) // group_rows)
    copies = min(groups, -(-MIN_SCARCE * groups // min(n_good, n_bad)))
    times = F.when((F.col("label") > 0.5) == F.lit(n_good <= n_bad), F.lit(copies)).otherwise(F.lit(1))
    rows = rows.withColumn("h", hex_of(SEED, "doc_id")).withColumn("times", times)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return rows.select(
        F.pmod(F.floor(unit_of(F.col("h")) * groups).cast("int") + F.col("copy"), F.lit(groups)).alias("group"),
        "h", "label", "x", (1 / F.col("times")).alias("share"), (F.col("copy") == 0).alias("first"),
    )


def pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a group's rows, in order of hashes: its number, and the bytes of features, labels, shares and marks."""
    rows = rows.sort_values("h")
    names = [np.stack(rows["x"].tolist()), *(rows[c].to_numpy(float) for c in ("label", "share", "first"))]
    return pd.DataFrame([[rows["group"].iloc[0], *(np.ascontiguousarray(v, float).tobytes() for v in names)]], columns=["group", "x", "label", "share", "first"])


def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The groups that ``pack`` made: number, features, labels, shares, marks."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            x, *others = (np.frombuffer(getattr(row, c)) for c in ("x", "label", "share", "first"))
            yield row.group, x.reshape(len(others[0]), -1), *others


def make_pairs(labels: np.ndarray, each: int = PAIRS_EACH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Indices (better, worse): every row meets ``each`` random rows of the other label."""
    good, bad = np.flatnonzero(labels > 0.5), np.flatnonzero(labels <= 0.5)
    if not len(good) or not len(bad):
        return np.empty(0, int), np.empty(0, int)
    rng = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(good, each), rng.choice(good, len(bad) * each)])
    worse = np.concatenate([rng.choice(bad, len(good) * each), np.repeat(bad, each)])
    return better, worse


def pair_sums(x: np.ndarray, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature at ``w`` of the summed, weighted logistic loss of feature differences."""
    d = x[better] - x[worse]
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # that the pair is ranked wrongly
    return -(weight * p) @ d, (d * (weight * p * (1 - p))[:, None]).T @ d


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights that minimise a loss, given its slope and curvature at any weights, plus the ridge."""
    w = np.zeros(size)
    for _ in range(steps):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + ridge * np.eye(size), slope + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of feature differences plus the ridge, by Newton's method."""
    if not len(better):
        return np.zeros(x.shape[1])
    share = weight / weight.sum()
    return newton(lambda w: pair_sums(x, better, worse, share, w), x.shape[1], ridge, steps)


class Ranker:
    """Standardised features, their squares, weights, and the threshold on strengths."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, cut: float = CUT, ridge: float = RIDGE) -> None:
        """Fitted on rows in memory, which meet as one group; ``train`` fits on tables."""
        x = np.asarray(x, float).reshape(-1, len(FEATURES))
        self.scale(x.mean(axis=0) if len(x) else np.zeros(len(FEATURES)), x.std(axis=0) if len(x) else np.ones(len(FEATURES)), cut)
        z = self.expand(x)
        better, worse = make_pairs(labels)
        self.weights = fit_pairs(z, better, worse, np.ones(len(better)), ridge).round(6)
        strengths = np.sort(z @ self.weights)
        share = float((np.asarray(labels) <= 0.5).mean()) if len(x) else 0.0
        self.threshold = self.split(strengths, share) if len(better) else -np.inf

    def scale(self, middle: np.ndarray, spread: np.ndarray, cut: float = CUT) -> None:
        """Set what features are standardised by. Like weights it is rounded: sums differ in last digits by order."""
        self.middle, self.spread = np.round(middle, 9), np.round(spread, 9) + 1e-6
        self.shift = float(np.log(cut / (1 - cut)))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -6, 6)
        return np.concatenate([z, np.abs(z)], axis=1)

    @staticmethod
    def split(strengths: np.ndarray, share: float) -> float:
        """The middle of the widest gap close to the quantile (within a tenth of the rejected share of it)."""
        n = len(strengths)
        at = int(round(share * n))
        slack = max(1, int(0.1 * share * n))
        low, high = max(1, at - slack), min(n - 1, at + slack)
        if low > high:
            return float(np.quantile(strengths, share))
        gaps = strengths[low : high + 1] - strengths[low - 1 : high]
        i = low + int(gaps.argmax())
        return float((strengths[i] + strengths[i - 1]) / 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``cut`` or more from the threshold up. Without pairs to learn from everything scores 0.5."""
        if self.threshold == -np.inf:
            return np.full(len(x), 0.5)
        strength = self.expand(np.asarray(x, float)) @ self.weights
        return 1 / (1 + np.exp(np.clip(-(strength - self.threshold + self.shift), -40, 40)))


def fit_groups(groups: DataFrame, model: Ranker, pairs: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights fitted on all pairs within the packed ``groups``; ``pairs`` is the sum of their weights."""
    size = 2 * len(FEATURES)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slope, curve, least = np.zeros(size), np.zeros((size, size)), -1
            for group, x, labels, share, _ in unpack(batches):
                better, worse = make_pairs(labels, seed=SEED + group)
                good = labels > 0.5
                weight = np.repeat(np.concatenate([share[good], share[~good]]), PAIRS_EACH)
                if len(better):
                    more = pair_sums(model.expand(x), better, worse, weight, w)
                    slope, curve = slope + more[0], curve + more[1]
                least = group if least < 0 else min(least, group)
            yield pd.DataFrame({"least": [least], "slope": [slope.tobytes()], "curve": [curve.tobytes()]})

        with small_batches(groups.sparkSession):
            parts = sorted(groups.mapInPandas(add, "least int, slope binary, curve binary").collect())
        slope, curve = (sum(np.frombuffer(p[c]) for p in parts) / pairs for c in ("slope", "curve"))
        return slope, curve.reshape(size, size)

    return newton(sums, size, ridge).round(6)


def strengths_of(groups: DataFrame, model: Ranker) -> DataFrame:
    """(s, n): the strengths of all rows of the packed ``groups`` and how many rows have each."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, x, _, _, first in unpack(batches):
            yield pd.DataFrame({"s": model.expand(x[first > 0]) @ model.weights})

    return groups.mapInPandas(compute, "s double").groupBy("s").agg(F.count("*").alias("n"))


def split_point(values: DataFrame, n_bad: int, n: int) -> float:
    """What ``Ranker.split`` gives for the strengths ``values`` (s, n) of ``n`` rows, ``n_bad`` of them labelled 0 (neither none nor all).

    Values are ranked within ranges; only the ranges' counts and ends pass the driver.
    """
    slack = max(1, int(0.1 * n_bad))
    low, high = max(1, n_bad - slack), min(n - 1, n_bad + slack)
    least, most = values.agg(F.min("s"), F.max("s")).first()
    values = values.withColumn("bin", F.floor((F.col("s") - least) / F.lit((most - least) or 1.0) * BINS).cast("int"))
    bins = values.groupBy("bin").agg(F.sum("n").alias("n"), F.max("s").alias("last")).toPandas().sort_values("bin")
    starts = pd.DataFrame({"bin": bins["bin"], "before": bins["n"].cumsum() - bins["n"], "last": bins["last"].shift().fillna(least)})
    starts = values.sparkSession.createDataFrame(starts, "bin int, before long, last double")
    order = Window.partitionBy("bin").orderBy("s")
    ranked = values.join(F.broadcast(starts), "bin").select(
        "s", "n", (F.col("before") + F.sum("n").over(order) - F.col("n")).alias("below"), F.coalesce(F.lag("s").over(order), "last").alias("prior")
    )
    inside = ranked.filter((F.col("below") + F.col("n") > low) & (F.col("below") <= high))
    inside = inside.withColumn("prior", F.when(F.col("below") >= low, F.col("prior")).otherwise(F.col("s")))
    s, prior = inside.orderBy(F.desc(F.col("s") - F.col("prior")), "s").select("s", "prior").first()
    return (s + prior) / 2


def train(docs: DataFrame, labels: DataFrame, cut: float = CUT, group_rows: int = GROUP_ROWS) -> Ranker:
    """Fit on all labelled rows outside the held-out fifth. Without rows of both labels the model keeps everything."""
    rows = written(labelled_features(docs, labels, "quality"), "quality-rows")
    x = [F.col("x")[i] for i in range(len(FEATURES))]
    n, n_good, *moments = rows.agg(
        F.count("*"), F.count_if(F.col("label") > 0.5), *map(F.avg, x), *map(F.stddev_pop, x)
    ).first()
    model = Ranker(np.zeros((0, len(FEATURES))), np.zeros(0), cut)
    if not 0 < n_good < n:
        return model
    model.scale(np.array(moments[: len(FEATURES)]), np.array(moments[len(FEATURES) :]), cut)
    groups = grouped(rows, n_good, n - n_good, group_rows).groupBy("group").applyInPandas(pack, "group int, x binary, label binary, share binary, first binary")
    groups = written(groups, "quality-groups")
    model.weights = fit_groups(groups, model, float(n * PAIRS_EACH))
    model.threshold = split_point(written(strengths_of(groups, model), "quality-strengths"), n - n_good, n)
    return model


def score_documents(df: DataFrame, model: Ranker, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` added or replaced; every other column stays.

    Null texts are scored as empty ones; whole texts of any length are read. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch.tolist()]).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x))

    df, back = apart(df, text_col, score_col)
    return together(df.withColumn(score_col, compute(text_col)), back)


def keep_quality(df: DataFrame, model: Ranker, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``df`` that score ``cut`` or more, with their columns as they were.

    Null texts count as empty ones and are judged as such; of repeated rows all stay or none; an empty table gives an empty
    result.
    """
    mark = free_name(df, "quality_score")
    return score_documents(df, model, text_col, mark).filter(F.col(mark) >= cut).drop(mark)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a ranker fitted on labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


SQL: dict[str, str] = {}
