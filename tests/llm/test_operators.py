"""The ten operators on small tables: brute force, round trips, nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloway.llm import bpe, exact_dedup, html_text, minhash, mixing, quality, sharding, topk, toxicity, warc
from siloway.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ID string"


def docs(spark, texts, source="src0"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


# --- registration --------------------------------------------------------------------------------------------------


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
    assert set(SQL) <= set(QUERIES)


# --- 1 mixing ------------------------------------------------------------------------------------------------------


def test_poisson_counts_and_rates(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15000, "big").otherwise("small").alias("source"))
    mixed = mixing.mix_sources(df, weights={"big": 1, "small": 1})
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(got["big"] - 10000) < 400 and abs(got["small"] - 10000) < 400
    counts = mixed.filter("source = 'small'").groupBy("doc_id").count().select("count").toPandas()["count"].to_numpy()
    share = {k: (counts == k).sum() / 5000 for k in (1, 2, 3)}
    for k, p in ((1, 0.2707), (2, 0.2707), (3, 0.1804)):
        assert abs(share[k] - p) < 0.03


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    df = docs(spark, [None, "", "a", "a"], source=None)
    out = mixing.mix_sources(df, epochs=1000.0)
    assert set(out.columns) == {*df.columns, "copy_no", "n_copies", "order_key"}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {0, 1, 2, 3}
    keys = [r.order_key for r in out.select("order_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix_sources(df, weights={"other": 1.0}).count() == 0


# --- 2 html --------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, and so on, and so forth.</p></div><main><article><h1>Title &amp; more</h1><p>First, a   paragraph<br>of some words, long enough.
<p>Second <b>bold</b> one&nbsp;here.</p><form><input><p>Sign up</p></form><div class="share-buttons">Share</div><ul><li>point one<li>point two</ul></article>
<section id="comments"><p>Nice, very nice, so nice, I say, and I mean it, every word of it.</p></section></main><aside><p>Other, things, to, read, here, now.</p></aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst, a paragraph of some words, long enough.\n\nSecond bold one here.\n\npoint one\n\npoint two"


def test_pages_without_an_article():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_text.main_text("<p>one<p>two<div>three") == "one\n\ntwo\n\nthree"
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"
    assert html_text.main_text('<p class="a>b">quoted > mark</p><!-- <p>no</p>') == "quoted > mark"


PROSE = "A sentence of the article, long enough to score, with words that go on, and on, to the end of it."


def in_article(inner):
    return f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{f'<p>{PROSE}</p>' * 5}{inner}</article><footer>us</footer></body>"


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<h2 id="search-results">Found</h2><p id="social-effects">Effects.</p>', ["Found", "Effects."]),
        ('<h2 id="legal-form">Legal form</h2><p class="notice">Note.</p>', ["Legal form", "Note."]),
        ('<section id="discussion"><h2>Discussion</h2><p>Short.</p></section>', ["Discussion", "Short."]),
        (f'<section id="reactions"><p>{PROSE}</p><p>{PROSE}</p></section>', [PROSE, PROSE]),
        ('<section id="cookies"><h2>Cookies</h2><p>They are baked.</p></section>', ["Cookies", "They are baked."]),
        ('<div class="search-results">Found it</div>', ["Found it"]),
        ("<ol><li><a href=1>A linked long title</a> 2001</ol><table><tr><td><a href=2>linked</a> x</table>", ["A linked long title 2001", "linked x"]),
        ('<blockquote><a href=1>All of it linked</a></blockquote><section><a href=2>See there</a> now</section>', ["All of it linked", "See there now"]),
        ('<p>See <span class="social">social</span> ends</p>', ["See social ends"]),
        ('<div class="share-buttons">Share</div><div class="ad">Buy, now</div><form><p>Sign up</p></form>', []),
        ('<div id="discussion"><div class="comment"><p>So nice, so very nice, I say.</p></div><textarea></textarea></div>', []),
        ('<div class="related"><ul><li><a href=1>Other</a></ul></div><div class="social">Follow us</div>', []),
    ],
)
def test_article_text_is_whole(inner, text):
    assert html_text.main_text(in_article(inner)) == "\n\n".join(["Title", *[PROSE] * 5, *text])


def test_page_in_one_form():
    page = f'<body><form id="aspnetForm" action="x"><input type=hidden><div id="content"><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div></form></body>'
    assert html_text.main_text(page) == "\n\n".join(["Title", PROSE, PROSE])


def test_headings_and_lists_next_to_the_best_container():
    page = f"<body><div><a href=/>Home</a></div><div><h2>Title</h2><div>{f'<p>{PROSE}</p>' * 6}</div><h3>Points</h3><ul><li>one<li>two</ul><h3>More</h3><ul><li><a href=1>Other page</a></ul></div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Title", *[PROSE] * 6, "Points", "one", "two"])


def test_comments_and_notices_of_any_length_stay_out():
    long = f"<p>{PROSE}</p>" * 30
    page = f'<body><div class="cookie-consent">{long}</div><div id="content"><p>{PROSE}</p>{f"<p>{PROSE}</p>" * 9}</div><div id="comments">{long}</div></body>'
    assert html_text.main_text(page) == "\n\n".join([PROSE] * 10)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old")], "page_id long, url string, html string, TEXT string")
    rows = html_text.extract_main_text(df.drop("TEXT")).orderBy("page_id").collect()
    assert [r.n_chars for r in rows] == [len(html_text.main_text(PAGE)), 0, 0]
    assert html_text.extract_main_text(df.drop("TEXT").limit(0)).count() == 0


# --- 3 near duplicates ---------------------------------------------------------------------------------------------


def brute_classes(texts):
    owner, ids, counts = minhash.shingles(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    part = [(ids[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in range(len(texts))]
    up = [*range(len(texts))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(texts)):
        for k in range(j):
            if minhash.similarity(*part[j], *part[k]) >= 0.8:
                a, b = sorted((root(j), root(k)))
                up[b] = a
    return [root(k) for k in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "one", "one", "two words", "x" * 200_000]
    for base in range(6):
        own = words(base, 80)
        for _ in range(7):
            copy = own[:]
            for at in rng.sample(range(80), rng.choice([0, 1, 1, 2, 3])):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = words(99, 100)  # neighbours are near, ends are not
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)]
    got = {r.id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicate_edges(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    kept = minhash.drop_near_duplicates(docs(spark, ["a b c d e f g"] * 3 + [None, None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns == docs(spark, []).columns


def test_signature_estimates_probability_jaccard():
    base = words(5, 300)
    other = base[:]
    for at in (10, 90, 200):
        other[at] = "changed"
    owner, ids, counts = minhash.shingles([" ".join(base), " ".join(other), " ".join(base[:60] * 4 + base)])
    sketch = minhash.signatures(owner, ids, counts, 3, 3000)
    cut = np.searchsorted(owner, np.arange(4))
    part = [(ids[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((sketch[i] == sketch[j]).mean() - minhash.similarity(*part[i], *part[j])) < 0.04


@pytest.mark.parametrize("seed", range(3))
def test_open_stars_lose_no_link(spark, seed):
    """Copies of one text around the limit, some with repeated shingles or shared edits, and texts with one passage."""
    rng = random.Random(seed)
    base, passage = words(seed, 60) + words(seed, 60)[:30 * (seed == 1)], words(100 + seed, 50)
    edits = [[f"edit{k}{j}" for j in range(2)] for k in range(6)]
    texts = []
    for _ in range(90):
        copy = base[:]
        for at in rng.sample(range(0, len(base), 3), rng.choice([0, 1, 2, 2, 3, 4])):
            copy[at : at + 1] = rng.choice(edits) if rng.random() < 0.6 else [f"own{rng.randrange(10**6)}"]
        texts.append(" ".join(copy[rng.choice([0, 0, 7]) :]))
    texts += [" ".join(words(1000 + 100 * seed + k, 30) + passage) for k in range(40)]
    got = {r.id: r.class_id for r in minhash.near_duplicates(docs(spark, texts), bands=40, rows=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_budget_bounds_the_shingles_of_one_text():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n = rng.integers(4, 40)
        x, y = rng.integers(1, rng.choice([2, 3, 6]), n), rng.integers(1, rng.choice([2, 3, 6]), n)
        x[rng.random(n) < 0.1] = 0
        y = np.where(rng.random(n) < 0.8, x, y)
        y[rng.random(n) < 0.1] = 0
        a, b = np.flatnonzero(x), np.flatnonzero(y)
        if len(a) and len(b):
            s = minhash.similarity(a, x[a], b, y[b])
            apart = len(np.setxor1d(a, b))
            assert apart <= minhash.budget(len(a), x.sum(), s) + minhash.budget(len(b), y.sum(), s) + 1e-9


def test_repeated_and_null_ids_and_counts(spark):
    long, other = " ".join(words(1, 50)), " ".join(words(2, 50))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (3, other), (4, other), (4, other), (5, None), (6, ""), (6, "")]
    got = collections.Counter((r.id, r.class_id, r.class_size) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 1, 3): 2, (2, 1, 3): 1, (3, 3, 3): 1, (4, 3, 3): 2, (5, 5, 3): 1, (6, 5, 3): 2}
    two = minhash.near_duplicates(spark.createDataFrame([(1, long), (1, other), (2, long), (3, other)], "doc_id long, text string")).collect()
    assert len(two) == 4 and len({r.class_id for r in two if r.id == 1}) == 1 and max(r.class_size for r in two) == 3


# --- 4 top-k -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [0.01, 2.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(400, 16)) * 64 * np.exp(rng.normal(size=(400, 1)) * spread)).astype(int)
    v[7] = v[11] = v[300]
    v[8] = 0
    df = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(v)], "vec_id long, vector array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, k=20, candidate_rows=90, query_rows=7)
    mine = [(r.query_id, r.rank, r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 400, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(400) if i != q))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert mine == want


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 8)]) for i in range(60)]
    rows += [rows[20], (20, [1, 2, 3, 4, 5, 6, 7, 8]), rows[3], (3, [40] * 8), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, k=20, candidate_rows=15, query_rows=2)
    mine = sorted((r.query_id, r.query_row, r.rank, r.vec_id, r.score) for r in got.collect())
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want, seen = [], collections.Counter()
    for i, v in distinct:
        if i % 20 == 0:
            seen[i] += 1
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in distinct if (j, w) != (i, v))[:20]
            want += [(i, seen[i], n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert seen == {0: 1, 20: 2, 40: 1} and mine == sorted(want)


def test_coordinates_prune_unit_vectors():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 64))
    v[:, :8] *= 3
    v = np.floor(v / np.sqrt((v**2).sum(1, keepdims=True)) * 64)
    ids, tally = np.arange(3000), {}
    floor = np.array([np.sort(np.delete(v @ v[q], q))[-25] for q in range(40)])
    got = topk.block_top_k(ids[:40], v[:40], ids, v, floor=floor, tally=tally)
    for q in range(40):
        best = sorted(((-s, i) for i, s in enumerate(v @ v[q]) if i != q))[:20]
        mine = got[got.query_id == q]
        assert [*zip(-mine.score, mine.vec_id, strict=True)] == best
    assert tally["coordinate_buckets"] > tally["length_buckets"] and tally["by_coordinates"] > 0.5 * 40 * 3000


def test_lengths_prune_vectors_of_many_lengths():
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(9000, 16)) * 20 * np.exp(rng.normal(size=(9000, 1)) * 1.5))
    ids, tally = np.arange(9000), {}
    got = topk.block_top_k(ids[:30], v[:30], ids, v, tally=tally)
    for q in range(30):
        assert sorted(got[got.query_id == q].score)[::-1] == sorted(np.delete(v @ v[q], q))[::-1][:20]
    assert tally["by_length"] > 0.4 * 30 * 9000


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_over_classes_of_lengths(spark, spread):
    rng = np.random.default_rng(9)
    v = np.floor(rng.normal(size=(500, 8)) * 30 * np.exp(rng.normal(size=(500, 1)) * spread)).astype(int)
    df = spark.createDataFrame([*((i, [int(x) for x in row]) for i, row in enumerate(v)), (700, [])], "vec_id long, vector array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, k=5, candidate_rows=60, query_rows=6).collect()
    for q in range(0, 500, 20):
        best = sorted([*((-int(v[q] @ v[i]), i) for i in range(500) if i != q), (0, 700)])[:5]
        assert sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q) == [(n, *b) for n, b in enumerate(best, 1)]
    assert len([r for r in got if r.query_id == 700]) == 5


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, None]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(topk.usable(F.col("embedding")))
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    assert sorted(r.vec_id for r in v.collect()) == [0, 1]
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(v.filter("vec_id = 0"), v).collect()] == [(0, 1, 64 * 64 * 3)]
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


# --- 5 bpe ---------------------------------------------------------------------------------------------------------

HARD = [
    None, "", "   ", "Hello, world's don't IT'LL 123 4x5!!", "<|startoftext|>a<|endoftext|><|endoftext|> b", "ΑΣ ΣΑΣ é ́x İstanbul ŉ ß", "日本語 😀👍🏽 ±≠½ ²Ⅻ", "\x00\x1c a\x1db \x7f", "aaaa" * 3000, "x" * 50_000, "'s's'S 'T",
]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    texts = HARD + [" ".join(words(i, 60)) + "tion&&& And THE." for i in range(20)]
    out = bpe.encode_documents(docs(spark, texts), path)
    decoded = bpe.decode_documents(out, path).orderBy("doc_id").collect()
    for row, text in zip(decoded, texts, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_text == library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(row.decoded_text.encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, []), path).count() == 0


def test_bpe_memory_bounds_change_nothing(monkeypatch):
    path = bpe.default_tokenizer()
    texts = [" ".join(words(i, 200)) for i in range(30)]
    want = [*bpe.Encoder(path).encode(texts)]
    for name, value in (("MEMO_CHUNKS", 50), ("MEMO_WORDS", 40), ("TRIE_WORDS", 20), ("MEMO_PAIRS", 10)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.Encoder(path)
    assert [e for i in range(0, 30, 3) for e in small.encode(texts[i : i + 3])] == want


# --- 6 warc --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    pages = [(1, "http://a/ b", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (4, "u", "same"), (4, "u", "same"), (9, "v", "y" * 300_000), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.archive_index(df, version=version).collect()
    got = collections.Counter((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    long, same = pages[0][2], "same"
    want = [(1, len(long.encode()), b32(long), "response", None), (2, 0, b32(""), "response", None), (3, 0, b32(""), "revisit", 2), (4, len(long.encode()), b32(long), "revisit", 1)]
    want += [(4, 4, b32(same), "response", None), (4, 4, b32(same), "revisit", 4), (9, 300_000, b32("y" * 300_000), "response", None), (None, 4, b32(same), "revisit", 4)]
    assert got == collections.Counter(want)
    assert warc.archive_index(df.limit(0)).count() == 0


def test_archives_keep_any_bytes(spark):
    odd = ["café\r\n\r\n".encode("latin-1"), "päge".encode("utf-16"), bytes(range(256)) * 20, b"\xff\xfe\x00\n\n", b"", "café\r\n\r\n".encode("latin-1"), "ok".encode()]
    df = spark.createDataFrame([(i, "u", b) for i, b in enumerate(odd)], "page_id long, url string, html binary")
    got = {r.source_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.archive_index(df).collect()}
    assert got == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), 0 if i == 5 else None) for i, b in enumerate(odd)}


def test_min_bytes_keeps_small_payloads(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    assert {r.source_id: r.record_type for r in warc.archive_index(df, min_bytes=5).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_broken_arc_is_refused():
    block = warc.arc_version_block(1, "x")
    with pytest.raises(ValueError):
        [*warc.arc_records(block + b"http://a 0.0.0.0 20200101000000 text/html 50\nshort\n")]


# --- 7 sharding ----------------------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(9).alias("SLOT2"))
    rows = sharding.interleave(df).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == [*range(8)] and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    total = collections.Counter(r.source for r in rows)
    for part in by.values():
        assert sorted(r.slot for r in part) == [*range(len(part))]
        own = collections.Counter(r.source for r in part)
        assert all(abs(own[s] - n / 8) <= 1.0 for s, n in total.items())


def test_sharding_edges(spark):
    assert sharding.interleave(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 2, "doc_id long, source string")
    rows = sharding.interleave(same, shards=3).collect()
    assert collections.Counter(r.shard for r in rows) == {0: 3, 1: 2, 2: 2}


# --- 8 quality -----------------------------------------------------------------------------------------------------


def test_quality_ranks_held_out(spark):
    from siloway.llm.common import table

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) / len(rows) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, ["a", "b"]), none)
    scored = quality.score_documents(docs(spark, [None, "", "z" * 500_000, "a b"]), model)
    assert [r.score for r in scored.collect()] == [0.5] * 4
    assert quality.keep_quality(docs(spark, ["a"]), model).columns == docs(spark, []).columns
    assert quality.score_documents(docs(spark, []), model).count() == 0


# --- 9 exact duplicates --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep, runs", [("max", 256), ("min", 3), ("max", 1)])
def test_exact_classes(spark, keep, runs):
    texts = ["Abc", "aBC", None, "", "É", "é", "z" * 100_000] + ["hot"] * 50
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
    best = max if keep == "max" else min
    rows = exact_dedup.duplicate_classes(docs(spark, texts), keep=keep, runs=runs, fan_in=4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        (text, ids), = [(t, x) for t, x in want.items() if r.id in x]
        assert (r.keep_id, r.group_size, r.kept) == (best(ids), len(ids), r.id == best(ids))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_edges(spark):
    assert exact_dedup.duplicate_classes(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "A"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(df).collect()) == [(1, "b"), (2, "A"), (3, "")]


# --- 10 toxicity ---------------------------------------------------------------------------------------------------


def distance(a, b):
    """Edits with swaps of neighbours, by the full table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_distances():
    terms = ["idiot", "moron", "worthless", "scum", "stupid", "disgusting"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 5.0), {})
    rng = random.Random(4)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) or 1)
            kind = rng.randrange(4)
            if kind == 0 and w:
                w[at] = rng.choice("abcdeimost")
            elif kind == 1:
                w.insert(at, rng.choice("abcdeimost"))
            elif kind == 2 and w:
                del w[at]
            elif at + 1 < len(w):
                w[at], w[at + 1] = w[at + 1], w[at]
        word = "".join(w)
        assert (lexicon.weight(word) > 0) == any(distance(t, word) <= toxicity.edits_for(len(t)) for t in terms), word


def test_context_parts_quotation_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"lowei": 4.0})
    (abuse,) = lexicon.hits("what an idi0t he is")
    (quoted,) = lexicon.hits('he read "idiot" aloud')
    (stem,) = lexicon.hits("LOWEISCHAFT")
    assert abuse[4] == "abuse" and quoted[4] == "quoted" and quoted[3] < abuse[3] and stem[3] == 4.0
    assert lexicon.hits(None) == lexicon.hits("") == lexicon.hits("idiosyncratic loser") == []


def test_toxicity_held_out(spark):
    from siloway.llm.common import table

    sf = "/root/testdata/sf0.1"
    docs_, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = toxicity.train(docs_, labels)
    rows = toxicity.score_documents(docs_.join(labels, "doc_id").filter(quality.held_out()), model).select("score", "toxic").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    assert sum(s >= 0.5 for s in toxic) / len(toxic) >= 0.85 and sum(s >= 0.5 for s in clean) / len(clean) <= 0.02


def test_toxicity_edges(spark):
    model = toxicity.train(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scored = toxicity.score_documents(docs(spark, [None, "", "x " * 100_000]), model)
    assert all(0 <= r.score < 0.5 for r in scored.collect())
    assert toxicity.score_documents(docs(spark, []), model).count() == 0
