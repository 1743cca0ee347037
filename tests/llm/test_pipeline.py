"""The pipeline's stages against brute force on a small fixture."""

import hashlib

import corpus_pipeline
from siloway.llm import minhash, mixing, quality
from siloway.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = quality.train(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, r in rows.items() if model.scores([quality.features(r.text)])[0] >= quality.CUT}

    stage = dict(corpus_pipeline.STAGES)
    after = corpus_pipeline.written(stage["quality"](spark, docs, SF), "t")
    assert after.columns == columns and {r.doc_id for r in after.collect()} == kept

    best = {}
    for i in kept:
        key = "".join(c.lower() if c.isascii() else c for c in rows[i].text)
        best[key] = max(i, best.get(key, -1))
    after = corpus_pipeline.written(stage["exact dedup"](spark, after, SF), "t")
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(best.values())

    classes = {r.id: r.class_id for r in minhash.near_duplicates(after).collect()}
    after = corpus_pipeline.written(stage["near dedup"](spark, after, SF), "t")
    assert after.columns == columns and {r.doc_id for r in after.collect()} == set(classes.values())

    counts = {r.doc_id: r.n_copies for r in mixing.mix_sources(after).collect()}
    after = corpus_pipeline.written(stage["mixing"](spark, after, SF), "t")
    assert after.columns == columns and after.count() == sum(counts.values())

    out = stage["bpe"](spark, after, SF).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.default_tokenizer())
    assert len(out) == sum(counts.values())
    for r in out:
        ids = library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_nulls_empty_tables_and_more_columns(spark):
    long, other = " ".join(f"word{i} and" for i in range(60)), " ".join(f"other{i} or" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, extra int"
    rows = [(1, long), (2, long.upper()), (3, long + " end"), (4, other), (4, other), (5, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.filter("false")):
            out = stage(spark, df, SF)
            assert name == "bpe" or out.columns == docs.columns, name
            assert (out.count() == 0) == (df is not docs), name
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["exact dedup"](spark, docs, SF).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [2, 3, 4, 4, 6]
    near = stage["near dedup"](spark, docs, SF).select("doc_id").collect()
    assert sorted(r[0] for r in near if r[0] is not None) == [1, 4, 4, 5] and len(near) == 5
    assert {r.n_tokens for r in stage["bpe"](spark, docs, SF).filter("doc_id in (5, 6)").select("n_tokens").collect()} == {0}
