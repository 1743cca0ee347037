"""Names that only letter case tells apart, repeated rows, long texts, and plain re-workings of parsers, fits and scores."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloway.llm import bpe, exact_dedup, html_text, minhash, mixing, quality, sharding, topk, toxicity, warc

CLASH = "doc_id long, text string, source string, TEXT string, Doc_Id string, N_TOKENS int, SCORE int, Copy_No int, Shard int, Toxic_Hits int"


@pytest.fixture
def clashing(spark):
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long, "a"), (2, long, "a"), (3, other, "b"), (4, None, None), (4, None, None), (None, "", "b"), (5, "x" * 30_000, "a")]
    return spark.createDataFrame([(i, t, s, "up", "id", 7, 8, 9, 10, 11) for i, t, s in rows], CLASH)


def kept_of(df):
    """The clashing columns, in order, and whether their values are all as they were."""
    names = [c for c in df.columns if c in CLASH]
    where = {c: i for i, c in enumerate(df.columns)}
    rows = df.collect()
    fixed = {"TEXT": "up", "Doc_Id": "id", "N_TOKENS": 7, "SCORE": 8, "Copy_No": 9, "Shard": 10, "Toxic_Hits": 11}
    return names, all(r[where[c]] == v for r in rows for c, v in fixed.items() if c in where), rows


def test_every_operator_tells_letter_case_apart(spark, clashing):
    path, model = bpe.default_tokenizer(), toxicity.Model(toxicity.Lexicon({"idiot": 5.0}, {}), toxicity.PRIOR)
    ranker = quality.Ranker(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    made = {
        "bpe": (bpe.encode_documents(clashing, path), 7), "mixing": (mixing.mix_sources(clashing, epochs=50.0), None), "sharding": (sharding.interleave(clashing, shards=2), 7),
        "quality": (quality.score_documents(clashing, ranker), 7), "keep": (quality.keep_quality(clashing, ranker), 7), "toxicity": (toxicity.score_documents(clashing, model), 7),
        "hits": (toxicity.toxic_hits(clashing, model), 7), "clean": (toxicity.drop_toxic(clashing, model), 7), "near": (minhash.drop_near_duplicates(clashing), 6), "exact": (exact_dedup.drop_exact_duplicates(clashing), 5),
    }
    for name, (df, n) in made.items():
        names, same, rows = kept_of(df)
        assert same and [c for c in clashing.columns if c in names] == clashing.columns, name
        assert n is None or len(rows) == n, (name, len(rows))
    assert minhash.near_duplicates(clashing).count() == 6 and exact_dedup.duplicate_classes(clashing).count() == 7


def test_html_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>one</p>", "old", 5, "T")], "page_id long, html string, text string, N_Chars int, TEXT string")
    out = html_text.extract_main_text(df)
    assert out.columns == ["page_id", "html", "N_Chars", "TEXT", "text", "n_chars"] and tuple(out.first()) == (1, "<p>one</p>", 5, "T", "one", 3)


def test_warc_reads_its_columns_only(spark):
    df = spark.createDataFrame([(1, "http://a", "<p>x</p>", b"z")], "page_id long, url string, html string, payload binary")
    assert [r.payload_bytes for r in warc.archive_index(df).collect()] == [8]


def test_documents_of_other_protocols_are_resources(spark, tmp_path):
    name = "x.arc"
    document = b"example.com. 60 IN A 1.2.3.4\n"
    head = b"HTTP/1.0 404 Not Found\r\nServer: old\r\n\r\n"
    body = warc.arc_version_block(1, name)
    for url, data in (("dns:example.com", document), ("http://e.com/", head + b"gone")):
        body += f"{url} 9.9.9.9 19990102030405 text/plain {len(data)}\n".encode() + data + b"\n"
    (tmp_path / "part-0.arc").write_bytes(body)
    records = warc.read_arc(spark, str(tmp_path))
    rows = {r.url: r for r in records.collect()}
    assert bytes(rows["dns:example.com"].payload) == document and rows["http://e.com/"].head.startswith("HTTP/1.0 404")
    folder = warc.convert(spark, str(tmp_path))
    kinds = {r.url: (r.record_type, r.payload_bytes) for r in warc.read_warc(spark, folder).collect()}
    assert kinds == {"dns:example.com": ("resource", len(document)), "http://e.com/": ("response", 4)}
    content = b"".join(warc.unpacked(bytes(r.content)) for r in warc._files(spark, folder).collect())
    assert b"WARC-Type: warcinfo" in content and b"HTTP/1.0 404 Not Found\r\nServer: old" in content and b"WARC-IP-Address: 9.9.9.9" in content


def test_hot_payload_is_one_entry_per_run(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, "").otherwise(F.col("id").cast("string")).alias("html"))
    rows = warc.archive_index(df).collect()
    assert collections.Counter((r.record_type, r.refers_to) for r in rows) == {("response", None): 1001, ("revisit", 1): 1999}


# --- repeated rows and long texts ----------------------------------------------------------------------------------


def test_long_and_repeated_texts(spark):
    df = spark.createDataFrame([(1, "ab " * 200_000, "s"), (1, "ab " * 200_000, "s"), (2, "idiot", "s")], "doc_id long, text string, source string")
    assert {r.n_copies for r in mixing.mix_sources(df, epochs=3.0).filter("doc_id = 1").collect()} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert sorted(r.slot for r in sharding.interleave(df, shards=1).collect()) == [0, 1, 2]
    model = toxicity.Model(toxicity.Lexicon({"idiot": 5.0}, {}), toxicity.PRIOR)
    scores = [r.score for r in toxicity.score_documents(df, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] < scores[2]
    ranker = quality.Ranker(np.array([quality.features("good words here"), quality.features("@@@@ ####")]), np.array([1.0, 0.0]))
    scores = [r.score for r in quality.score_documents(df, ranker).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and 0 <= scores[2] <= 1


def test_sample_takes_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: (r.text, r.label) for r in quality.labelled_sample(docs, labels, "quality").collect()}
    held = {r.doc_id for r in docs.filter(quality.held_out()).collect()}
    assert rows == {i: v for i, v in {1: ("b", 1.0), 2: (None, 0.0)}.items() if i not in held}


def test_empty_vectors(spark):
    df = spark.createDataFrame([(0, []), (20, []), (1, [])], "vec_id long, vector array<long>")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]


# --- the HTML parser against a step-by-step one ---------------------------------------------------------------------


def slow_tree(tags):
    """(tag, parent's number) of every element: each rule looked up by going down the open elements one by one."""
    found, stack = [("#root", -1)], [0]

    def cut(stop, ends):
        for at in range(len(stack) - 1, 0, -1):
            tag = found[stack[at]][0]
            if tag in ends:
                del stack[at:]
                return
            if tag in stop:
                return

    for closing, tag in tags:
        if closing:
            blocks = () if tag in html_text.BLOCK else html_text.BLOCK
            cut(blocks, {tag})
            continue
        if tag in html_text.BLOCK:
            cut(html_text.SCOPE, {"p"})
        if tag in html_text.CLOSES:
            ends, until = html_text.CLOSES[tag]
            cut(until, ends)
        found.append((tag, stack[-1]))
        if tag not in html_text.VOID:
            stack.append(len(found) - 1)
    return found


def test_parser_equals_a_step_by_step_one():
    rng = random.Random(11)
    names = "div p ul li a b i table tr td th dl dt dd h1 h2 section span article br button".split()
    for _ in range(400):
        tags = [(rng.random() < 0.4, rng.choice(names)) for _ in range(rng.randrange(40))]
        page = "".join(f"</{t}>" if c else f"<{t}>" for c, t in tags)
        nodes = html_text.parse(page)
        number = {id(n): i for i, n in enumerate(nodes)}
        assert [(n.tag, number[id(n.parent)] if n.parent else -1) for n in nodes] == slow_tree(tags), page


def test_long_broken_pages_end_soon():
    for page in ("<div>" * 60_000, "<i>" * 20_000 + "</u>" * 20_000, '<a "' * 50_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<b" * 50_000):
        html_text.main_text(page)
    assert html_text.main_text('<p class="x>one</p><p>two</p>') == "one\n\ntwo"


def test_references_are_decoded_by_text_node():
    assert html_text.main_text("<p>x&<b>lt;</b> &lt;y&gt;</p>") == "x&lt; <y>"


def test_named_parts_of_a_page_stay_out():
    prose = "<p>A sentence of the article, long enough to score, with words that go on, and on, to the end.</p>"
    article = f'<div id="content">{prose * 6}<ul><li><a href=1>Reference one</a></li></ul><p>so <math><mi>x</mi></math> it is, and so on.</p></div>'
    for name in ("page-footer", "main-sidebar", "post-share", "entry-related"):
        text = html_text.main_text(f'<body>{article}<div class="{name}"><a href=1>Terms</a> <a href=2>Privacy</a> all of it, ours</div></body>')
        assert "Terms" not in text and text.count("A sentence") == 6 and "so x it is" in text
    assert "Reference one" in html_text.main_text(f"<body><article>{article}</article></body>")


# --- fits and scores worked out plainly -----------------------------------------------------------------------------


def test_pair_fit_has_no_slope_left():
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(40, 3)), np.array([1.0] * 15 + [0.0] * 25)
    better, worse = quality.make_pairs(labels)
    assert collections.Counter(better.tolist()).keys() == set(range(15)) and set(worse.tolist()) == set(range(15, 40))
    assert all(collections.Counter(worse.tolist())[i] >= quality.PAIRS_EACH for i in range(15, 40))
    w = quality.fit_pairs(x, better, worse, np.ones(len(better)), 0.01)
    for f in range(3):
        slope = 0.01 * w[f]
        for b, c in zip(better, worse, strict=True):
            d = [x[b][j] - x[c][j] for j in range(3)]
            slope -= d[f] / (1 + math.exp(sum(a * v for a, v in zip(d, w, strict=True)))) / len(better)
        assert abs(slope) < 1e-6


def test_threshold_lies_in_the_widest_gap_near_the_quantile():
    strengths = np.array(sorted([*range(20), *[x + 30.5 for x in range(80)]]), float)
    assert quality.Ranker.split(strengths, 0.21) == (19 + 30.5) / 2


def test_terms_and_scores_by_full_tables(spark):
    toxic = ["you filthy scumbag go away", "filthy scumbag again today", "what a filthy scumbag indeed", "scumbag filthy person there"]
    clean = ["a quiet day by the river", "the river runs past town", "go away said the fox", "again today the town sleeps"]
    rows = [(i, t, 1.0, i % 2) for i, t in enumerate(toxic)] + [(10 + i, t, 0.0, i % 2) for i, t in enumerate(clean)]
    kept = spark.createDataFrame(rows, "doc_id long, text string, label double, fold int")
    counts = toxicity.term_counts(kept)
    by = {(r.term, r.stem): (r.toxic, r.clean) for r in counts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    want = collections.Counter()
    for texts, at in ((toxic, 0), (clean, 1)):
        for t in texts:
            words = set(t.split())
            for term in {(w, False) for w in words} | {(w[:n], True) for w in words for n in toxicity.STEM_SIZES if len(w) > n}:
                want[term, at] += 1
    assert by == {term: (want[term, 0], want[term, 1]) for term, _ in want}
    chosen = {r["term"] for r in toxicity.choose_terms(counts, 4, 4) if not r["stem"]}
    need = {w for (w, stem), (a, b) in by.items() if not stem and len(w) >= 4 and a >= 3 and a >= 4 * b and math.log((a + 0.5) / 5) - math.log((b + 0.5) / 5) >= toxicity.MIN_WEIGHT}
    assert chosen == need
    lexicon = toxicity.Lexicon({"scumbag": 4.0}, {})
    model = toxicity.Model(lexicon, np.array([1.0, 0.5, 0.2, 0.1, -2.0]))
    for text, abuse, quoted in (("a scumbag he is", [4.0], []), ('he read "scumbag" aloud', [], [4.0 * toxicity.QUOTED]), ("you scumbak", [4.0 * 0.6 * toxicity.ADDRESSED], []), ("calm river", [], [])):
        hits = [*abuse, *quoted]
        z = math.log1p(sum(abuse)) + 0.5 * math.log1p(sum(quoted)) + 0.2 * max(hits, default=0) + 0.1 * math.log1p(len(hits)) - 2
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-z)))
