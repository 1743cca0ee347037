"""N-gram join, vector codes and centroids: brute force, bounds that prune, ties, nulls, repeats, empty tables, clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloway.llm import centroids, ngram_join, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 n-gram join ------------------------------------------------------------------------------------------------


def gram_set(text, size=3):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(texts, p=9, q=10):
    sets = [gram_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def joined(spark, texts, **options):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    return sorted(map(tuple, ngram_join.ngram_join(df, **options).collect()))


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_join_finds_all_links_of_groups_and_pairs(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):  # small families at and about the threshold
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 120))]
        texts += [edited(rng, base, min(len(base), k)) for k in (0, 0, 1, 1, 2, 3)]
    hot = [f"h{rng.randrange(500)}" for _ in range(150)]
    texts += [edited(rng, hot, rng.choice((0, 1, 2, 3, 4, 6, 9))) for _ in range(120)]  # one large group, members apart
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 80))) for _ in range(60)]
    rng.shuffle(texts)
    want = brute_components(texts)
    assert joined(spark, texts) == want
    assert joined(spark, texts, candidates=1) == want  # all groups go to pivots
    assert joined(spark, texts, candidates=0, share=0.3) == want


def test_join_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(21)]  # 19 shingles
    same = " ".join(base)
    longer = " ".join([*base, "a"])  # 19 of 20 are shared
    texts = [same, longer, " ".join([*base, "a", "b"]), " ".join([*base, "c", "d", "e"]), " ".join(base[:11]), " ".join(base[:12]), "q r s", "q r", "q"]
    assert joined(spark, texts) == brute_components(texts)
    nine, ten = " ".join(base[:11]), " ".join(base[:12])
    assert joined(spark, [nine, ten]) == [(0, 9, 0), (1, 10, 0)]


def test_join_words_are_split_and_lowered_by_ascii_alone(spark):
    texts = ["Ä b c d", "ä b c d", "A b c d", "a\tb\x0bc\nd", "a b\x1cc d", "a b c d", None, "", " \t ", "x", "X", "x y"]
    assert joined(spark, texts) == brute_components(texts)


def test_join_edges(spark):
    schema = "doc_id long, text string, TEXT string, n long, grams string"
    rows = [(1, "a b c", "z", 1, None), (1, "a b c", "z", 1, None), (None, "a b c", "z", 1, "g"), (7, "A B C", "z", None, "g"), (9, None, None, None, None)]
    got = sorted(map(tuple, ngram_join.ngram_join(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (7, 1, 1), (9, 0, 9)]
    assert ngram_join.ngram_join(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    assert joined(spark, [long, long + " more", "other"]) == [(0, 59_998, 0), (1, 59_999, 0), (2, 1, 2)]


def test_rounds_settle_pairs_and_leave_out_documents_that_share_a_passage(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(40)) for _ in range(40)]
    texts += [texts[0] + " end"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").select("id", F.lit(0).cast("long").alias("version"), F.col("text").cast("binary").alias("text"))
    sets = ngram_join.document_sets(df, 3, None).select("id", "n", "grams")
    pairs, rest = ngram_join.multi_match(sets, None, candidates=4)
    assert {tuple(r) for r in pairs.collect()} == {(0, 40)} and rest.count() == 0


# --- 12 vector codes -----------------------------------------------------------------------------------------------


def slow_codes(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with Python's own numbers."""
    kept = sorted(((i, [int(np.floor(x * scale)) for x in v]) for i, v in rows), key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)]) for i, v in kept]
    books = [[x[p] for _, x in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), e) for e, m in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x in cut:
                groups.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, x in cut:
        found = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return sorted(out), books


@pytest.mark.parametrize("spread", [1.0, 0.02, 300.0])
def test_codes_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, spread, (300, 8)))]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # repeated vectors: ties and entries without parts
    df = spark.createDataFrame([(i, v, None if i % 3 else str(i % 2)) for i, v in rows], "vec_id long, embedding array<double>, label string")
    found, books = vector_codes.encode_vectors(df, parts=4, entries=12, rounds=4, scale=64)
    want, plain = slow_codes(rows, 4, 12, 4, 64)
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == want
    assert books.tolist() == plain
    totals = vector_codes.total_by(found, "label", "error", "label_error").collect()
    for r in totals:
        assert r.label_error == sum(x.error for x in totals if x.label == r.label)


def test_code_bounds_prune_and_hold():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (200, 3)) + c for c in (0, 300, 700, 1500)])
    book = x[rng.choice(len(x), 16, replace=False)]
    code, upper, lower = vector_codes.first_codes(x, book)
    tally = {}
    for _ in range(5):
        new = book.copy()
        for e in range(16):
            if (code == e).any():
                new[e] = x[code == e].sum(0) // (code == e).sum()
        shown, step = vector_codes.stepped(lower)
        code, upper, lower = vector_codes.next_codes(x, code, upper, shown * step[:, None], new, centroids.drifts(book, new), tally)
        book = new
        d = centroids.squared(x, book)
        assert (code == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), code])).all()
        others = lower.copy()
        others[np.arange(len(x)), code] = 0
        assert (others <= np.sqrt(d)).all()
    assert tally["left out"] > tally["done"]


def test_code_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, Label string, codes string"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1, "a", ""), (2, [None, 1.0], 1, "a", ""), (3, [nan, 1.0], 1, "a", ""), (4, [inf, 1.0], 1, "a", ""), (5, [], 1, "a", "")]
    found, books = vector_codes.encode_vectors(spark.createDataFrame(bad, schema), parts=2)
    assert found.collect() == [] and books.size == 0
    good = [(8, [0.5, -0.001], None, "a", ""), (8, [0.5, -0.001], 1, "a", ""), (None, [1.0, 2.0], 1, "a", ""), (9, [1.0], 1, "a", ""), (10, [1.0, 2.0, 3.0, 4.0], 1, "a", "")]
    found, books = vector_codes.encode_vectors(spark.createDataFrame(bad + good, schema), parts=2, entries=2, rounds=1, scale=256)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert [r[0] for r in rows] == [8, 8, None] and {r[2] for r in rows if r[0] == 8} == {"0101"}
    assert books.tolist() == [[[170], [128]], [[170], [-1]]]  # ties went to the first entry, the other stayed; all floors go down
    with pytest.raises(Exception, match="beyond"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1e9, 1.0], 1, "a", "")], schema), parts=2)


# --- 13 centroids --------------------------------------------------------------------------------------------------


def slow_clusters(rows, k, rounds, scale, seed):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, members in groups.items():
            middle[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), middle


@pytest.mark.parametrize("spread", [1.0, 0.01, 2000.0])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, spread, (250, 5)))]
    rows += [(2000 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, middle = centroids.cluster_vectors(df, k=6, rounds=7, size=5, scale=128)
    want, plain = slow_clusters(rows, 6, 7, 128, 3)
    assert sorted(map(tuple, found.collect())) == want
    assert middle.tolist() == plain


def test_cluster_bounds_prune_and_hold():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-50, 50, (300, 4)) + c for c in (0, 400, 900)])
    middle = v[[5, 10, 305, 610]]
    cluster, upper, lower = centroids.scan(v, middle)
    tally = {}
    for _ in range(8):
        new = middle.copy()
        for c in range(4):
            if (cluster == c).any():
                new[c] = v[cluster == c].sum(0) // (cluster == c).sum()
        cluster, upper, lower = centroids.reassigned(v, cluster, upper, lower, new, centroids.drifts(middle, new), tally)
        middle = new
        d = centroids.squared(v, middle)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(len(v)), cluster])
        d[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()
    assert tally["kept"] > tally["scanned"]


def test_whole_distances_of_large_components():
    v = np.array([[2**27, -(2**27)], [3, 4]])
    far = np.array([[-(2**27), 2**27], [0, 0]])
    assert centroids.squared(v, far).tolist() == [[2**57, 2**55], [(3 + 2**27) ** 2 + (4 - 2**27) ** 2, 25]]


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster int, Upper string"
    df = spark.createDataFrame([(1, None, 0, ""), (2, [1.0], 0, ""), (3, [float("inf"), 0.0], 0, ""), (4, [None, 0.0], 0, ""), (5, [], 0, "")], schema)
    found, middle = centroids.cluster_vectors(df, size=2)
    assert found.collect() == [] and len(middle) == 0
    few = spark.createDataFrame([(1, [1.0, 1.0], 0, ""), (1, [1.0, 1.0], 0, ""), (None, [0.0, 0.0], 0, "")], schema)
    found, middle = centroids.cluster_vectors(few, size=2, k=8, rounds=2, scale=1)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert len(middle) == 3 and [r[2] for r in rows] == [0, 0, 0]
    assert rows[0][1] == rows[1][1]  # equal vectors go to the smaller number of equal centroids
