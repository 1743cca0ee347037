"""The quality ranker's fit over all labelled rows, against fits in memory and plain counts."""

import hashlib
import zlib

import numpy as np
import pytest

from siloway.llm import quality

GOOD, DIGITS, LOUD = "kind words of every sort", "8123 77 words of every sort", "kind! words! of! every! sort!"


def training_ids(n):
    """Ids below ``n`` outside the held-out fifth, lowest hash first."""
    return sorted((i for i in range(n) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(f"{quality.SEED}|{i}".encode()).hexdigest())


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_rows_beyond_the_first_20000_are_learned_from(spark):
    ids = training_ids(28_000)
    assert len(ids) > 22_000
    rows = [(i, LOUD, 0) if k >= 20_000 else (i, DIGITS, 0) if k % 2 else (i, GOOD, 1) for k, i in enumerate(ids)]
    model = quality.train(*tables(spark, rows))
    good, digits, loud = model.scores([quality.features(t) for t in (GOOD, DIGITS, LOUD)])
    assert good >= quality.CUT > max(digits, loud)


def mixed(n, seed=1):
    """(doc_id, text, quality): texts with more or fewer digits, labels that mostly follow them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        text = " ".join(str(rng.integers(1, 999)) if rng.random() < (0.5 if bad else 0.3) else "word" + "abc"[rng.integers(3)] for _ in range(30))
        rows.append((i, text, int(not bad)))
    return rows


def test_one_group_gives_the_fit_in_memory(spark):
    rows = {i: (t, q) for i, t, q in mixed(400)}
    ids = training_ids(400)
    plain = quality.Ranker(np.array([quality.features(rows[i][0]) for i in ids]), np.array([rows[i][1] for i in ids], float))
    model = quality.train(*tables(spark, [(i, *v) for i, v in rows.items()]))
    assert np.allclose(model.middle, plain.middle) and np.allclose(model.spread, plain.spread)
    assert np.allclose(model.weights, plain.weights, atol=1e-5)
    assert model.threshold == pytest.approx(plain.threshold, abs=1e-4)


def test_many_groups_leave_no_slope(spark):
    docs, labels = tables(spark, mixed(600))
    model = quality.train(docs, labels, group_rows=60)
    rows = quality.labelled_features(docs, labels, "quality").collect()
    assert {r.doc_id for r in rows} == set(training_ids(600))
    n_good = sum(r.label > 0.5 for r in rows)
    groups = quality.grouped(spark.createDataFrame(rows), n_good, len(rows) - n_good, 60).toPandas()
    slope = quality.RIDGE * model.weights
    for number, group in groups.groupby("group"):
        group = group.sort_values("h")
        z, label, share = model.expand(np.stack(group["x"].tolist())), group["label"].to_numpy(), group["share"].to_numpy()
        own = [*np.flatnonzero(label > 0.5), *np.flatnonzero(label <= 0.5)]
        for k, (b, c) in enumerate(zip(*quality.make_pairs(label, seed=quality.SEED + number), strict=True)):
            d = z[b] - z[c]
            slope = slope - share[own[k // quality.PAIRS_EACH]] * d / (1 + np.exp(d @ model.weights)) / (len(rows) * quality.PAIRS_EACH)
    assert np.abs(slope).max() < 1e-5


def test_every_row_meets_the_other_label_when_that_is_rare(spark):
    rows = [(i, float(i % 300 == 0), [0.0]) for i in range(1500)]
    found = quality.grouped(spark.createDataFrame(rows, "doc_id long, label double, x array<double>"), 5, 1495, 50).collect()
    common = {r.group for r in found if r.label == 0}
    assert common == {r.group for r in found if r.label == 1} and len(common) == 30
    assert sum(r.first for r in found) == 1500 and sum(r.share for r in found) == pytest.approx(1500)
    assert len({r.h for r in found}) == 1500


def test_threshold_of_a_table_is_that_in_memory(spark):
    rng = np.random.default_rng(2)
    cases = [
        (np.array([*range(20), *[x + 30.5 for x in range(80)]], float), 21),
        (rng.normal(size=500), 120),
        (rng.integers(0, 6, 300).astype(float), 100),
        (np.zeros(40), 7),
        (np.array([1.0, 2.0]), 1),
        (np.array([*[-1000.0] * 3, *rng.normal(size=200)]), 50),
    ]
    for strengths, n_bad in cases:
        values, counts = np.unique(strengths, return_counts=True)
        table = spark.createDataFrame(list(zip(values.tolist(), counts.tolist(), strict=True)), "s double, n long")
        assert quality.split_point(table, n_bad, len(strengths)) == quality.Ranker.split(np.sort(strengths), n_bad / len(strengths))
