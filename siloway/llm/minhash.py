"""Near-duplicate detection by ProbMinHash: signatures, banding, exact verification, connected classes.

A text is the weighted set of its five-word shingles (lower-cased words; a shorter text is one shingle). Its similarity to
another is the probability Jaccard, which for weights of 1 is the usual Jaccard. Signatures: each shingle is a Poisson
process whose rate is its weight; arrivals hit registers at random, a register keeps its earliest shingle, and a shingle
is given up once its next arrival is later than every register's. Two texts agree in a register with a probability equal
to their similarity. Registers are cut into bands; texts that share a band are candidates.

Texts with equal shingles are one node from the start, so copies cost nothing further on. In each bucket of a band the
member with most company in all its buckets, one near the middle of its group, is the pivot, and every other member is
compared with it exactly, on whole texts. All buckets of one pivot are a star. The links so found are joined to components, and a star whose members are by then in one
component is done, whatever its size.

The other stars are searched without pairing their members. Write D for the shingles that only one of a member and its
pivot has. Two members differ in the shingles that only one of their D has, so a link needs a certain number of shingles
that both D have (``overlap`` below), and by the prefix principle two members without a common shingle among the first
|D| + 1 - overlap of each, rarest first, have no link. A member far from its pivot owes that to edits of its own, which
come first and meet nothing; only members with the same edits meet, and those are compared. What all members share with
the pivot, a common passage say, is in no D at all. This is exact: candidates are linked, compared, or proven apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, table, together, written

#: Words of a shingle, least similarity of a link, bands and registers in each.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5

#: Bands of distance to the pivot that a star's members are told apart by, and pairs with one pivot that meet in a task.
LEVELS, HUB_ROWS = 8, 512

#: Words that a task works off at once, and words whose hashes it remembers.
CHUNK_WORDS, MEMO_WORDS = 150_000, 100_000

#: Parts that the rows of a class or of a copied text are dealt to.
RUNS = 256

WORD = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_ID_BITS = np.uint64((1 << 44) - 1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit numbers (multiply and shift rounds); wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _ODD[1]
        x = (x ^ (x >> np.uint64(27))) * _ODD[2]
        return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def shingles(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: (index of the text, 44-bit id, count), sorted by text and id. Null texts have none."""
    hashes, counts, get = [], [], _hashes.__getitem__
    for text in texts:
        words = WORD.findall(text.lower()) if text else []
        counts.append(len(words))
        hashes.append(np.fromiter(map(get, words), np.uint64, len(words)))
    n = np.array(counts, np.int64)
    flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    width = np.minimum(n, size)[owner]  # a shorter text is one shingle of all its words
    rolled = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            ahead = np.zeros(len(flat), np.uint64)
            ahead[: max(0, len(flat) - k)] = flat[k:]
            ahead[width <= k] = 0
            rolled = rolled * _ODD[3] + ahead
    first = place + width <= n[owner]
    ids = mixed(rolled[first] + width[first].astype(np.uint64)) & _ID_BITS
    key = np.sort((owner[first].astype(np.uint64) << np.uint64(44)) | ids)  # at most 2**20 texts at once
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> np.uint64(44)).astype(np.int64), key[at] & _ID_BITS, np.diff(np.append(at, len(key)))


def signatures(owner: np.ndarray, ids: np.ndarray, counts: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row of ``registers`` shingle ids per text; a text without shingles gets zeros."""
    earliest = np.full((texts, registers), np.inf)
    sketch = np.zeros((texts, registers), np.uint64)
    flat_e, flat_s = earliest.reshape(-1), sketch.reshape(-1)
    latest = np.full(texts, np.inf)
    seed, rate = mixed(ids, 1), 1.0 / counts
    doc, own, clock = owner, ids, np.zeros(len(ids))
    arrival = 0
    while len(doc):
        arrival += 1
        draw = mixed(seed, 2 * arrival)
        clock = clock - np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)) * rate
        live = clock < latest[doc]
        doc, own, clock, seed, rate = doc[live], own[live], clock[live], seed[live], rate[live]
        if not len(doc):
            break
        slot = doc * registers + ((mixed(seed, 2 * arrival + 1) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        better = clock < flat_e[slot]
        s, t, o = slot[better], clock[better], own[better]
        np.minimum.at(flat_e, s, t)
        won = flat_e[s] == t
        flat_s[s[won]] = o[won]
        touched = np.flatnonzero(np.bincount(doc, minlength=texts)) if arrival < 4 else np.unique(doc)
        latest[touched] = earliest[touched].max(axis=1)
    return sketch


def banded(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number per band of each signature."""
    out = np.zeros((len(sketch), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = (out + sketch.reshape(-1, bands, rows)[:, :, r]) * _ODD[3]
    return mixed(out, 3)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets: sorted ids and their weights. Two empty sets are equal, one is unlike any."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    shared = int(both.sum())
    if not shared:
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return shared / (len(a) + len(b) - shared)
    xs, ys = x[both].astype(float), y[at[both]].astype(float)
    only_x, only_y = float(x.sum() - xs.sum()), float(y.sum() - ys.sum())
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    ratio = xs / ys
    low = np.searchsorted(ratio, ratio, "left")
    above = np.append(np.cumsum(xs[::-1])[::-1], 0.0)[low] + only_x
    below = np.append(0.0, np.cumsum(ys))[low] + only_y
    return float((1 / (above / xs + below / ys)).sum())


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of these lengths that hold about CHUNK_WORDS words; a longer text ends its stretch."""
    start = size = 0
    for i, n in enumerate(lengths):
        size += n // 6 + 1
        if size >= CHUNK_WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def sketch_documents(df: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """(id, version, key_a, key_b, bands): a hash of the text, two 64-bit hashes of its weighted shingles, its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for start, end in _chunks(pc.binary_length(texts).fill_null(0).to_pylist()):
                n = end - start
                owner, ids, counts = shingles(texts.slice(start, n).to_pylist(), size)
                keys = []
                for salt in (5, 6):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, mixed(ids, salt) * counts.astype(np.uint64))
                    keys.append(pa.array(total.view(np.int64)))
                sketch = banded(signatures(owner, ids, counts, n, bands * rows), bands, rows).view(np.int64)
                some = np.bincount(owner, minlength=n) > 0
                ends = np.append(0, np.cumsum(some * bands)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), *keys, lists], ["id", "version", "key_a", "key_b", "bands"])
        _hashes.clear()  # workers live on; what they remember would stay with them

    text = F.col(text_col).cast("string")
    rows_in = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows_in.mapInArrow(run, "id long, version long, key_a long, key_b long, bands array<long>")


def beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, part, ...) with both texts as ``left`` and ``right``; a text that many pairs name as b is dealt out by part."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    dealt = pairs.select("b", "part").distinct().join(right, "b")
    return pairs.join(left, "a").join(dealt, ["b", "part"])


def _set_pairs(a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ids and counts of the left text, ids and counts of the right text) of rows of pairs."""
    rows = [*zip(a, b, left, right, strict=True)]
    for start, end in _chunks([len(s or "") + len(t or "") for _, _, s, t in rows]):
        unique = {i: s for i, _, s, _ in rows[start:end]} | {j: t for _, j, _, t in rows[start:end]}
        number = {i: k for k, i in enumerate(unique)}
        owner, ids, counts = shingles([*unique.values()], size)
        cut = np.searchsorted(owner, np.arange(len(unique) + 1))
        for at in range(start, end):
            i, j = (slice(cut[k], cut[k + 1]) for k in (number[rows[at][0]], number[rows[at][1]]))
            yield at, ids[i], counts[i], ids[j], counts[j]
    _hashes.clear()


def verified(pairs: DataFrame, texts: DataFrame, size: int = WORDS) -> DataFrame:
    """(a, b, distance) of distinct pairs of ids: 1 - similarity of their whole texts. ``texts`` is (id, text), ids unique."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for at, x, xs, y, ys in _set_pairs(a, b, left, right, size):
            out[at] = 1 - similarity(x, xs, y, ys)
        return pd.Series(out)

    return beside(pairs, texts).select("a", "b", compare("a", "b", "left", "right").alias("distance"))


def budget(shingled: int, mass: int, least: float) -> float:
    """What a text of so many distinct shingles and such a sum of counts adds to the shingles that a link may leave unshared.

    A term of the probability Jaccard is at most max(x, y) / M, where M is the sum of max(x, y) over all shingles, so
    similarity s means that shingles of one text alone weigh at most (1 - s) M. M is at most both sums of counts less the
    number of shared shingles; solving for the number that only one text has gives this bound, a sum over both texts. For
    counts of 1 it is exact.
    """
    return 2 * (1 - least) / (1 + least) * (mass - shingled / 2)


def differences(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """``pairs`` of members (a) and pivots (b) with ``delta``, the shingles that one of the two texts lacks; ``shares``, what
    each of them is of the member's weight (0 if the member lacks it); ``height``, their
    number less the member's budget; ``step``, the width of a level of heights in stars of this pivot; and ``top``, the
    share of the member's weight in its heaviest shingles, a quarter of the pivot's number and one."""

    @F.pandas_udf("delta array<long>, shares array<float>, height double, step long, top double")
    def differ(a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(a)
        for at, x, xs, y, _ in _set_pairs(a, b, left, right, size):
            own = ~np.isin(x, y, assume_unique=True)
            delta = np.concatenate([x[own], np.setdiff1d(y, x, assume_unique=True)]).view(np.int64)
            shares = np.zeros(len(delta), np.float32)
            shares[: own.sum()] = xs[own] / xs.sum()
            heavy = np.sort(xs)[-(len(y) // 4 + 1) :].sum() / xs.sum()
            out[at] = (delta, shares, len(delta) - budget(len(x), int(xs.sum()), least), max(1, len(y) // LEVELS), float(heavy))
        return pd.DataFrame(out, columns=["delta", "shares", "height", "step", "top"])

    kept = [c for c in pairs.columns if c != "part"]
    return beside(pairs, texts).select(*kept, differ("a", "b", "left", "right").alias("d")).select(*kept, "d.*")


def unproven(stars: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """(a, b, part) of members of different components in one star that may be linked.

    ``stars`` is (a: member, b: pivot, part, component, inner: whether that is the pivot's). A link of members with
    heights h and g needs ceil((h + g) / 2) shingles in both differences, so they have to share one among the first
    |D| + 1 - that many. A member shows its shingles to each level of heights, as many as the smallest height there asks for.
    Shingles that only members of one component have in their differences come first and are passed over.

    A pair may need no shared shingle at all, but only if a member repeats shingles so often that its budget covers them:
    otherwise both members are of the pivot's component, and such pairs are not looked for. These pairs meet by ``top``:
    similarity is at most 1 less the total variation of both weights, which the tops cannot differ by more than. And
    with weights that sum to 1, shingles of one text alone weigh at most (1 - least) * (2 - least) in a link, so what the
    components of two members have for themselves in both (``alone``) cannot be more.
    """
    found = written(differences(stars, texts, least, size), "differences")
    each = found.select(F.col("b").alias("pivot"), F.col("a").alias("id"), "component", F.explode(F.arrays_zip("delta", "shares")).alias("s"))
    each = each.select("pivot", "id", "component", F.col("s.delta").alias("shingle"), F.col("s.shares").cast("double").alias("share"))
    common = each.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = common.filter("low <> high").select("pivot", "shingle", "n")
    mine = each.join(common, ["pivot", "shingle"]).groupBy("pivot", "id")
    mine = mine.agg(F.sort_array(F.collect_list(F.struct("n", "shingle")))["shingle"].alias("shared"), F.sum("share").alias("met"))
    spare = (1 - least) * (2 - least) + 1e-5  # shares are single floats
    owned = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x.cast("double"))
    steps = F.col("height") / F.col("step")
    beyond = F.floor(F.log(F.greatest(F.abs(steps) / LEVELS, F.lit(1.0))) / math.log(1.5))  # far levels are wider
    level = F.when(F.abs(steps) < LEVELS, F.floor(steps)).otherwise(F.signum(steps) * (LEVELS + 1 + beyond)).cast("long") * 2 + F.col("inner").cast("int")
    cell = F.floor(F.col("top") / (1 - least + 1e-9)).cast("long")
    members = (
        found.select(F.col("b").alias("pivot"), F.col("a").alias("id"), "component", "inner", "height", "top", F.size("delta").alias("all"), level.alias("level"), owned.alias("owned"))
        .join(mine, ["pivot", "id"], "left")
        .withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
        .withColumn("alone", F.col("owned") - F.coalesce("met", F.lit(0.0)))
        .filter(F.col("alone") <= spare)
    )
    members = written(members, "star-members")
    lows = members.groupBy("pivot", "level").agg(F.min("height").alias("low"), F.min("inner").alias("inside"), F.max(F.size("shared")).alias("most"), F.min("alone").alias("spared"))
    levels = lows.groupBy("pivot").agg(F.collect_list(F.struct("level", "low", "inside", "most", "spared")).alias("levels"))  # they grow with the logarithm of heights
    needed = F.ceil((F.col("height") + F.col("other.low")) / 2 - 1e-9)
    ahead = F.least(F.size("shared") + 1 - F.greatest(needed, F.lit(1)), F.size("shared")).cast("int")
    none = F.expr("cast(array() as array<struct<shingle: bigint, at: int>>)")
    first = F.transform(F.slice("shared", 1, F.greatest(ahead, F.lit(0))), lambda x, i: F.struct(x.alias("shingle"), (i + 1).cast("int").alias("at")))
    cells = F.transform(F.array(-1 - cell, -2 - cell), lambda x: F.struct(x.alias("shingle"), F.lit(0).alias("at")))
    keys = (
        members.join(levels, "pivot")
        .withColumn("other", F.explode("levels"))
        .filter("not (inner and other.inside)")
        .filter((needed <= F.col("other.most")) & (needed <= F.size("shared")) & (F.col("alone") + F.col("other.spared") <= spare))
        .select(
            "pivot", "id", "component", "level", "height", "top", "alone", F.size("shared").alias("held"), F.col("other.level").alias("facing"),
            F.explode(F.concat(first, F.when(needed <= 0, cells).otherwise(none))).alias("e"),
        )
        .withColumns({"shingle": F.col("e.shingle"), "at": F.col("e.at"), "low": F.least("level", "facing"), "high": F.greatest("level", "facing")})
        .drop("facing", "e")
    )
    keys = written(keys, "star-keys")
    key = ["pivot", "shingle", "low", "high"]
    parts = keys.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("from"), F.max("level").alias("to"))
    open_keys = parts.groupBy(*key).agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("parts"), F.min("from").alias("from"), F.max("to").alias("to"))
    open_keys = open_keys.filter((F.col("parts") > 1) & (F.col("from") == F.col("low")) & (F.col("to") == F.col("high"))).select(*key, "major")
    rows = written(keys.join(open_keys, key), "open-keys")
    facts = ["component", "level", "height", "top", "alone", "held", "at"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, "major", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in facts])

    minor, other = side(rows.filter("component <> major"), "a").drop("major"), side(rows, "b")
    both = F.ceil((F.col("a_height") + F.col("b_height")) / 2 - 1e-9)
    # places count from the first shingle that is not a component's alone, and so do the numbers held
    in_prefix = (F.col("a_at") <= F.col("a_held") + 1 - both) & (F.col("b_at") <= F.col("b_held") + 1 - both)
    met = minor.join(other, key).filter(
        (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("major")) | (F.col("a") < F.col("b")))
        & ((F.col("low") == F.col("high")) | (F.col("a_level") != F.col("b_level")))
        & F.when(F.col("shingle") < 0, both <= 0).otherwise((both > 0) & in_prefix)
        & (F.abs(F.col("a_top") - F.col("b_top")) <= 1 - least + 1e-9)
        & (F.col("a_alone") + F.col("b_alone") <= spare)
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("part")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node is linked to. Links are (a, b); nodes without any are left out.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so chains shorten
    twofold. Rounds are written out and end when no label changes.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id")
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        after = written(stepped.join(jump, "label", "left").select("id", "was", F.least("label", "beyond").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.filter("label <> was").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def _one_row_each(sketched: DataFrame) -> DataFrame:
    """Sketches with ``rows``, the number of rows of an id; of an id's texts the one whose hash is greatest."""
    counted = sketched.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max("version").alias("version")).filter("rows > 1")
    if not counted.limit(1).count():
        return sketched.withColumn("rows", F.lit(1).cast("long"))
    one = sketched.join(counted, ["id", "version"]).dropDuplicates(["id"]).select(*sketched.columns, "rows")
    return written(sketched.join(counted, "id", "left_anti").withColumn("rows", F.lit(1).cast("long")).unionByName(one), "sketches")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = WORDS
) -> DataFrame:
    """(id, class_id, class_size) of every row: the smallest id of its class of near copies and the number of rows in it.

    Rows of a class are joined by links of similarity ``least`` or more. Texts with equal shingles, null and empty texts
    among themselves included, are one class. Ids are taken to be distinct: rows repeating an id count as one text, that
    whose hash is greatest, and each gets the id's class. Rows with a null id are left out. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    df, _ = apart(df, id_col, text_col)
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = _one_row_each(written(sketch_documents(docs, "id", "text", bands, rows, size), "sketches"))
    key = ["key_a", "key_b"]
    reps = sketched.groupBy(*key).agg(F.min("id").alias("rep"), F.sum("rows").alias("n"), F.min_by("bands", "id").alias("bands"))
    reps = written(reps, "representatives")

    member = written(reps.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "value")), "band-rows")
    bucket = ["band", "value"]
    shared = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sharing = written(member.join(shared, bucket), "bucket-rows")
    weight = sharing.groupBy("id").agg(F.sum("members").alias("weight"))
    rank = F.struct("weight", F.xxhash64("id").alias("h"), F.col("id"))
    pivots = sharing.join(weight, "id").groupBy(*bucket).agg(F.max(rank)["id"].alias("pivot"))
    met = sharing.join(pivots, bucket).filter("id <> pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.max("members").alias("members"))
    part = F.pmod(F.xxhash64("a"), F.floor(F.col("members") / HUB_ROWS) + 1)
    met = written(met.select("a", "b", part.alias("part")), "stars")

    # the texts that some comparison can need
    needed = written(met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct(), "candidates")
    texts = docs.join(needed, "id", "left_semi").groupBy("id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    texts = written(texts, "candidate-texts")

    links = written(verified(met, texts, size), "star-distances").filter(F.col("distance") <= 1 - least + 1e-12).select("a", "b")
    comps = components(links)

    # stars that lie in several components
    inside, around = comps.select(F.col("id").alias("a"), F.col("component").alias("a_part")), comps.select(F.col("id").alias("b"), F.col("component").alias("b_part"))
    placed = met.join(inside, "a", "left").join(around, "b", "left")
    placed = placed.select("a", "b", "part", F.coalesce("a_part", "a").alias("component"), F.coalesce(F.coalesce("a_part", "a") == F.coalesce("b_part", "b"), F.lit(False)).alias("inner"))
    placed = written(placed, "placed-stars")
    several = placed.groupBy("b").agg(F.count(F.lit(1)).alias("members"), F.min("inner").alias("whole")).filter("members > 1 and not whole").select("b")
    hidden = written(unproven(placed.join(several, "b", "left_semi"), texts, least, size), "hidden-pairs")
    if hidden.limit(1).count():
        more = written(verified(hidden, texts, size).filter(F.col("distance") <= 1 - least + 1e-12).select("a", "b"), "hidden-links")
        if more.limit(1).count():
            comps = components(links.unionByName(more))

    # a class or a copied text of any size is one entry per run, so no join gathers its rows
    run = F.pmod(F.xxhash64("id"), F.lit(RUNS)).cast("int").alias("run")
    counted = comps.select("id", "component", run).join(reps.select(F.col("rep").alias("id"), *key, "n"), "id")
    counted = written(counted, "linked")
    by_run = counted.groupBy("component", "run").agg(F.sum("n").alias("n"))
    totals = by_run.groupBy("component").agg(F.sum("n").alias("class_size"))
    sizes = by_run.select("component", "run").join(totals, "component")
    linked = counted.join(sizes, ["component", "run"]).select(*key, F.col("component").alias("class_id"), "class_size")
    copied = reps.filter("n > 1").join(counted.select(*key), key, "left_anti").select(*key, F.col("rep").alias("class_id"), F.col("n").alias("class_size"))
    classes = linked.unionByName(copied)
    rows_of = sketched.select("id", "rows", *key, run)
    down = rows_of.select("run", *key).distinct().join(classes, key)
    out = rows_of.join(down, ["run", *key], "left").select("id", "rows", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", "rows").alias("class_size"))
    return out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("id", "class_id", "class_size")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its class, with all their columns; rows without an id stay too.

    Null and empty texts are one class, of which one id stays; rows that repeat an id that stays all stay. Columns are
    matched by their exact names. An empty table gives an empty result.
    """
    df, back = apart(df, id_col, text_col)
    mark = free_name(df, "dropped_id")
    dropped = near_duplicates(df, id_col, text_col, **options).filter("id <> class_id").select(F.col("id").alias(mark)).distinct()
    return together(df.join(dropped, df[id_col] == dropped[mark], "left_anti"), back)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id and the size of its class of near copies; ``kept`` marks the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept")
    )


SQL: dict[str, str] = {}
