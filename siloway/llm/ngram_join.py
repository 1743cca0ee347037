"""Similarity join of documents on sets of word n-grams, by adaptive multi-match prefixes.

Two sets link when shared / union is at least P / Q; with D for the number of n-grams that only one has and n for a size
that is (P + Q) D <= (Q - P) (n_a + n_b), in whole numbers (19 D <= n_a + n_b at nine tenths). All steps are exact.

Two documents that link share at least o n-grams, o being n P / Q of either, rounded up. With n-grams in any one order for all
documents, they share m of the first n - o + m of each. The order is that of the number of documents that hold an
n-gram, fewest first, so a prefix meets few others. Each document lengthens its prefix as far as that pays: a longer one
costs more rows to join and asks a candidate for more matches m, so for fewer verifications; company of the prefix over m is the
estimate of the candidates. A pair has to share the lesser of its documents' m. Where the estimate is at most ``CANDIDATES``
the document is settled: its candidates are verified on whole sets. The others go on among themselves.

The first round does this on a sample of each document, so that not all n-grams are counted: its first n - o + l by hash,
of which two that link share l likewise, with l a share of n. Only documents that are not alone after it are read again, and
the second round, on whole sets and with numbers of the documents that are left, settles those that a common passage had kept.

What is left after it lives in large groups of much alike documents, and is not paired. Of each prefix n-gram the document
with most company is the pivot, and the others are compared with the pivot only. Let D be the n-grams that only one of a
member and its pivot has: two members differ in what only one of their D holds, so a link asks for a number of n-grams in
both D, and prefixes of the D, rarest first, find the members that may link. Members joined to one component by then are
not searched. Their D also say how much two members differ, so no text is read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, table, written
from siloway.llm.minhash import CHUNK_WORDS, RUNS, _one_row_each, components, mixed

#: Words of a shingle, and least similarity of a link as a fraction.
WORDS, LEAST = 3, (9, 10)

#: Matches of the sample, as a share of a document's n-grams, candidates that a settled document may have, matches to choose from.
SHARE, CANDIDATES, MATCHES = 0.1, 8, (1, 2, 4, 8, 16, 32)

#: Rows of one partner that meet in a task, and words whose hashes a task remembers.
HUB_ROWS, MEMO_WORDS = 512, 100_000

#: Levels of distance to the pivot on either side of zero that have equal width; farther ones are wider.
LEVELS = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words in UTF-8, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def ngram_sets(texts: list[bytes | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts in UTF-8: (index of the text, 64-bit hash), sorted by both. A shorter text is one n-gram.

    Words are stretches without ASCII white space, A-Z lower-cased: what bytes' own ``lower`` and ``split`` do.
    """
    hashes, counts, get = [], [], _hashes.__getitem__
    for text in texts:
        words = text.lower().split() if text else []
        counts.append(len(words))
        hashes.append(np.fromiter(map(get, words), np.uint64, len(words)))
    n = np.array(counts, np.int64)
    flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(n, size)[owner]
    rolled = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            ahead = np.zeros(len(flat), np.uint64)
            ahead[: max(0, len(flat) - k)] = flat[k:]
            ahead[width <= k] = 0
            rolled = mixed(rolled * _MIX + ahead, k + 1)
    first = place + width <= n[owner]
    who, grams = owner[first], mixed(rolled[first] + width[first].astype(np.uint64))
    order = np.lexsort((grams, who))
    who, grams = who[order], grams[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (grams[1:] != grams[:-1])
    return who[new], grams[new]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts that hold about CHUNK_WORDS words; a longer text ends its stretch."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n // 6 + 1
        if size >= CHUNK_WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(who: np.ndarray, grams: np.ndarray, n: np.ndarray, shown: np.ndarray) -> pa.Array:
    """The first ``shown`` of each text's n-grams as a list column."""
    place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    ends = np.append(0, np.cumsum(shown)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[place < shown[who]].view(np.int64)))


def smallest_overlap(n: Column, least: tuple[int, int] = LEAST) -> Column:
    """The least number of n-grams that a document of ``n`` shares with one that it links with; and the least size of that one."""
    return F.ceil(n * F.lit(least[0]) / F.lit(least[1]) - F.lit(1e-9))


def sampled(n: Column, share: float) -> Column:
    """Matches in samples of two documents of ``n`` n-grams: one at least."""
    return F.greatest(F.floor(n * F.lit(share)), F.lit(1).cast("long"))


def document_sets(df: DataFrame, size: int, share: float | None, least: tuple[int, int] = LEAST) -> DataFrame:
    """(id, version, n, key_a, key_b, grams) of ``df`` (id, version, text in UTF-8): number of n-grams, two 64-bit hashes of
    the set, and its n-grams in the order of their hashes: the sample for ``share``, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for start, end in _chunks(texts):
                rows = end - start
                who, grams = ngram_sets(texts.slice(start, rows).to_pylist(), size)
                n = np.bincount(who, minlength=rows).astype(np.int64)
                keys = []
                for salt in (5, 6):
                    total = np.zeros(rows, np.uint64)
                    np.add.at(total, who, mixed(grams, salt))
                    keys.append(pa.array(total.view(np.int64)))
                shown = n
                if share is not None:
                    shown = np.minimum(n, n - -(-n * least[0] // least[1]) + np.maximum(np.floor(n * share).astype(np.int64), 1))
                columns = [batch.column(0).slice(start, rows), batch.column(1).slice(start, rows), pa.array(n), *keys, _lists(who, grams, n, shown)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "n", "key_a", "key_b", "grams"])
        _hashes.clear()  # workers live on; what they remember would stay with them

    return df.mapInArrow(run, "id long, version long, n long, key_a long, key_b long, grams array<long>")


def linked(difference: Column, sizes: Column, least: tuple[int, int] = LEAST) -> Column:
    """Whether two sets whose sizes sum to ``sizes`` and that differ in so many n-grams link."""
    p, q = least
    return difference * (p + q) <= sizes * (q - p)


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``part``: the rows of a partner ``b`` whom many name are dealt to parts."""
    counts = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows_of_b")), "partners")
    part = F.pmod(F.xxhash64("a"), F.floor(F.col("rows_of_b") / HUB_ROWS) + 1)
    return pairs.join(counts, "b").withColumn("part", part).drop("rows_of_b")


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, part) with sizes and n-grams of both: a_n, b_n, a_grams, b_grams."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("grams").alias("a_grams"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("grams").alias("b_grams"))
    return pairs.join(left, "a").join(pairs.select("b", "part").distinct().join(right, "b"), ["b", "part"])


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by their whole sets."""
    both = beside(dealt(pairs), sets)
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    sizes = F.col("a_n") + F.col("b_n")
    return both.filter(linked(sizes - 2 * shared, sizes, least)).select("a", "b")


def ranked(held: Column, gram: Column) -> Column:
    """One number for an n-gram and its company, in the order of the company: 23 bits of it, 40 of the n-gram. N-grams with
    one number count as one, which adds candidates and loses none."""
    return F.shiftleft(F.least(held, F.lit((1 << 23) - 1)).cast("long"), 40).bitwiseOR(gram.bitwiseAND(F.lit((1 << 40) - 1)))


def multi_match(sets: DataFrame, share: float | None, least: tuple[int, int] = LEAST, candidates: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """One round over ``sets`` (id, n, grams: the sample for ``share``, or all): (pairs (a, b) of settled documents to verify,
    the documents that go on: (id, n, first)). ``first`` are the n-grams, with their company, of which two documents that link
    have one in common.

    A sample shares the lesser of its two documents' numbers, so a document counts on the number of its smallest partner.
    """
    shared = smallest_overlap(F.col("n"), least) if share is None else sampled(smallest_overlap(F.col("n"), least), share)
    rows = sets.select("id", F.explode("grams").alias("gram"))
    common = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "common-grams")
    held = rows.join(common, "gram").groupBy("id").agg(F.sort_array(F.collect_list(ranked(F.col("held"), F.col("gram")))).alias("all"))
    facts = sets.select("id", "n", F.size("grams").alias("shown"), shared.cast("int").alias("asked"))
    # n-grams that no other document shows come first and match nothing
    facts = facts.join(held, "id").withColumn("spare", F.size("all") - F.col("asked")).filter("spare >= 0")

    def choice(m: int) -> Column:
        kept = F.slice("all", F.lit(1), F.least(F.size("all"), F.col("spare") + m))
        return F.struct(F.lit(m).alias("m"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, k: a + F.shiftright(k, 40) - 1).alias("company"))

    priced = facts.withColumn("choices", F.array(*[F.when(F.col("asked") >= m, choice(m)) for m in MATCHES]))
    # rows to join, and n-grams of the candidates to verify
    cost = F.transform("choices", lambda c: F.struct((c["company"] + c["company"] / c["m"] * F.col("n")).alias("cost"), c["m"].alias("m"), c["company"].alias("company")))
    priced = priced.withColumn("best", F.array_min(F.filter(cost, lambda c: c["cost"].isNotNull())))
    alive = priced.select("id", "n", F.col("best.m").alias("m"), (F.col("best.company") <= candidates * F.col("best.m")).alias("settled"), "spare", "all")
    alive = written(alive, "alive")
    placed = written(alive.select("id", "n", "m", "settled", F.explode(F.slice("all", F.lit(1), F.col("spare") + F.col("m"))).alias("gram")), "alive-grams")
    some = placed.filter("settled").select("gram", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("m").alias("a_m"))
    other = placed.select("gram", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("m").alias("b_m"), F.col("settled").alias("b_settled"))
    p, q = least
    close = (F.col("a_n") * p <= F.col("b_n") * q) & (F.col("b_n") * p <= F.col("a_n") * q)
    # a settled document's n-grams are shown by few, so these pairs are bounded by the prefixes
    met = some.join(other, "gram").filter(close & (F.col("a") != F.col("b")) & (~F.col("b_settled") | (F.col("a") < F.col("b"))))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.min(F.least("a_m", "b_m")).alias("m")).filter("found >= m")
    rest = alive.filter("not settled").select("id", "n", F.slice("all", F.lit(1), F.col("spare") + 1).alias("first"))
    return pairs.select("a", "b"), rest


def stars(rest: DataFrame) -> DataFrame:
    """(a, b) of documents and pivots, such that two of ``rest`` (id, first) that link have a pivot in common or one is the other's."""
    weight = F.aggregate("first", F.lit(0).cast("long"), lambda a, k: a + F.shiftright(k, 40))
    kept = written(rest.select("id", weight.alias("weight"), F.explode("first").alias("gram")), "star-rows")
    pivots = kept.groupBy("gram").agg(F.max(F.struct("weight", F.xxhash64("id").alias("h"), F.col("id")))["id"].alias("b"))
    return kept.join(written(pivots, "pivots"), "gram").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def differences(met: DataFrame, sets: DataFrame) -> DataFrame:
    """``met`` (a, b) with sizes a_n and b_n and ``delta``, the n-grams that only one of the two has."""
    delta = F.concat(F.array_except("a_grams", "b_grams"), F.array_except("b_grams", "a_grams"))
    return beside(dealt(met), sets).select("a", "b", "a_n", "b_n", delta.alias("delta"))


def hidden_pairs(found: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, c, b) of members a and c of one star, that of b, and of different components, that may link.

    ``found`` is (a, b, a_n, b_n, delta, component). A link of members with heights h and g needs (h + g) / 2 n-grams in both
    differences, where a height is the difference's size less what the member's own size allows. One of the first
    |delta| + 1 - that many is then common to both, in any order; the rarest come first. N-grams that one component has for
    itself match nothing and are passed over. A member shows a prefix to each level of heights, as long as the lowest
    height there asks for. At least one is asked for: without any, both are near the pivot and of its component.
    """
    p, q = least
    each = found.select("b", "a", "component", F.explode("delta").alias("gram"))
    common = each.groupBy("b", "gram").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = written(common.filter("low <> high").select("b", "gram", "held"), "star-common")
    mine = each.join(common, ["b", "gram"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(ranked(F.col("held"), F.col("gram")))).alias("shared"))
    # heights in units of 1 / (p + q), so that they are whole
    height = F.size("delta") * (p + q) - F.col("a_n") * (q - p)
    steps = F.col("height") / F.greatest(F.floor(F.col("b_n") * (q - p) / 4), F.lit(1).cast("long"))
    beyond = F.floor(F.log(F.greatest(F.abs(steps) / LEVELS, F.lit(1.0))) / math.log(1.5))
    level = F.when(F.abs(steps) < LEVELS, F.floor(steps)).otherwise(F.signum(steps) * (LEVELS + 1 + beyond)).cast("long")
    members = found.select("b", "a", "component", "b_n", height.alias("height")).join(mine, ["b", "a"]).withColumn("level", level)
    members = written(members, "star-members")
    lows = members.groupBy("b", "level").agg(F.min("height").alias("low"), F.max(F.size("shared")).alias("most"))
    levels = lows.groupBy("b").agg(F.collect_list(F.struct("level", "low", "most")).alias("levels"))  # they grow with the logarithm of heights
    needed = F.greatest(F.ceil((F.col("height") + F.col("other.low")) / (2.0 * (p + q)) - 1e-9), F.lit(1).cast("long"))
    keys = (
        members.join(levels, "b")
        .withColumn("other", F.explode("levels"))
        .filter((needed <= F.col("other.most")) & (needed <= F.size("shared")))
        .withColumn("prefix", F.slice("shared", F.lit(1), (F.size("shared") + 1 - needed).cast("int")))
        .select(
            "b", "a", "component", "level", "height", F.size("shared").alias("held"), F.least("level", "other.level").alias("low"),
            F.greatest("level", "other.level").alias("high"), F.posexplode("prefix").alias("at", "gram"),
        )
    )
    keys = written(keys, "star-keys")
    key = ["b", "gram", "low", "high"]
    parts = keys.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("from"), F.max("level").alias("to"))
    open_keys = parts.groupBy(*key).agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("parts"), F.min("from").alias("from"), F.max("to").alias("to"))
    open_keys = open_keys.filter((F.col("parts") > 1) & (F.col("from") == F.col("low")) & (F.col("to") == F.col("high"))).select(*key, "major")
    rows = written(keys.join(written(open_keys, "open-grams"), key), "open-keys")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, "major", F.col("a").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("component", "level", "height", "held", "at")])

    minor, other = side(rows.filter("component <> major"), "x").drop("major"), side(rows, "y")
    both = F.greatest(F.ceil((F.col("x_height") + F.col("y_height")) / (2.0 * (p + q)) - 1e-9), F.lit(1).cast("long"))
    pairs = minor.join(other, key).filter(
        (F.col("x_component") != F.col("y_component"))
        & ((F.col("y_component") == F.col("major")) | (F.col("x") < F.col("y")))
        & ((F.col("low") == F.col("high")) | (F.col("x_level") != F.col("y_level")))
        & (F.col("x_at") <= F.col("x_held") - both)
        & (F.col("y_at") <= F.col("y_held") - both)
    )
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("c"), "b").distinct()


def hidden_links(pairs: DataFrame, found: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The (a, c) of ``pairs`` that link, by their differences from the pivot that they share."""
    left = found.select("a", "b", F.col("a_n").alias("n"), "delta")
    right = found.select(F.col("a").alias("c"), "b", F.col("a_n").alias("c_n"), F.col("delta").alias("c_delta"))
    apart_by = F.size("delta") + F.size("c_delta") - 2 * F.size(F.array_intersect("delta", "c_delta"))
    both = pairs.join(left, ["a", "b"]).join(right, ["c", "b"])
    return both.filter(linked(apart_by, F.col("n") + F.col("c_n"), least)).select("a", F.col("c").alias("b")).distinct()


def grouped_links(rest: DataFrame, sets: DataFrame, links: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (a, b) that join the documents of ``rest`` (id, first) to the components that all their links make, given
    ``links`` already found: with pivots, and between members that these leave in different components. ``sets`` is (id, n, grams)."""
    found = written(differences(written(stars(rest), "stars"), sets), "star-differences")
    near = written(links.unionByName(found.filter(linked(F.size("delta"), F.col("a_n") + F.col("b_n"), least)).select("a", "b")), "near-links")
    where = components(near)
    placed = found.join(where.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    placed = written(placed, "placed-stars")
    split = written(placed.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("b"), "open-stars")
    if not split.limit(1).count():
        return near
    still = placed.join(split, "b", "left_semi")
    more = hidden_links(written(hidden_pairs(still, least), "hidden-pairs"), still, least)
    return near.unionByName(written(more, "hidden-links"))


def ngram_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, least: tuple[int, int] = LEAST,
    share: float = SHARE, candidates: int = CANDIDATES,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set of n-grams and the smallest id that links reach.

    Null and empty texts, and texts of white space, have no n-grams and are linked with nothing; equal sets are linked,
    whatever the texts. Ids are taken to be distinct: rows repeating an id count as one text, that whose hash is greatest,
    and each gets the id's result. Rows with a null id are left out. Other columns are not read, whatever their names.
    An empty table gives an empty result. N-grams are told apart by 64-bit hashes, sets by two such sums over them.
    """
    df, _ = apart(df, id_col, text_col)
    text = F.col(text_col).cast("string")
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    sketched = _one_row_each(written(document_sets(docs, size, share, least), "ngram-sketches"))
    key = ["key_a", "key_b"]
    # sets that differ have sizes of (P + Q) / (Q - P) together at least, so those under P / (Q - P) have no other partners
    reps = sketched.filter("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "grams"), "id").alias("s"))
    reps = written(reps.select(*key, F.col("rep").alias("id"), "s.n", "s.grams"), "ngram-representatives")
    p, q = least
    joinable = reps.filter(F.col("n") * (q - p) >= p).select("id", "n", "grams")

    near, rest = multi_match(joinable, share, least, candidates)
    near = written(near, "settled-pairs")
    needed = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).unionByName(rest.select("id")).distinct()
    texts = docs.join(written(needed, "needed"), "id", "left_semi").groupBy("id", "version").agg(F.first("text").alias("text"))
    texts = texts.join(sketched.select("id", "version"), ["id", "version"], "left_semi").select("id", "version", "text")
    sets = written(document_sets(texts, size, None, least).select("id", "n", "grams"), "ngram-sets")
    more, rest = multi_match(sets.join(rest.select("id"), "id", "left_semi"), None, least, candidates)
    links = written(verified(near.unionByName(written(more, "settled-pairs")), sets, least), "settled-links")
    links = grouped_links(rest, sets, links, least)
    where = components(links)

    # a set that many documents have is one entry per run, so no join gathers its rows
    run = F.pmod(F.xxhash64("id"), F.lit(RUNS)).cast("int").alias("run")
    named = reps.select(*key, "id").join(where, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    rows_of = sketched.select("id", "rows", "n", *key, run)
    down = rows_of.filter("n > 0").select("run", *key).distinct().join(named, key)
    out = rows_of.join(down, ["run", *key], "left").select("id", "rows", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("id", "n_shingles", "component_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and the smallest doc_id that links of nine tenths reach."""
    return ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = {
    "op11_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * met >= 90 * (sa.n + sb.n - met)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""
}
