"""Toxicity by Levenshtein automata intersected with a lexicon trie, weighted by the context of each hit.

The lexicon is learned from labelled rows: words, and stems that several words share, whose document frequency in toxic
texts far exceeds that in clean ones. Its terms stand in a trie. A word is read through the Levenshtein automata of all
terms at once: a state is the set of (trie node, edits spent) that the letters so far can reach, so states are sets of
trie positions and the transitions, found as words need them, are the intersection of automata and trie. Swapped
neighbours count as one edit. Words that clean texts use are exempt from inexact hits.

Around each hit a window of words is read. Quotation marks about the hit or words of reporting make it a quoted hit, which
counts for little; words of address make it weigh more. A logistic over the summed weights of both kinds, fitted on
labelled texts that its lexicon has not seen, gives the score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, table, together, written
from siloway.llm.quality import held_out, labelled_sample

#: Labelled rows that the lexicon is learned from at most. Terms and exempt words are words of these rows and so bounded.
SAMPLE_ROWS = 20_000

#: What a term needs: texts it is in, its log odds of being in a toxic text, and for a stem the words it begins.
MIN_TEXTS, MIN_WEIGHT, MIN_STEM_WORDS = 3, 2.5, 5
STEM_SIZES = (4, 5, 6)

#: Words on each side that make a hit's context, and what a quoted and an addressed hit count for.
WINDOW, QUOTED, ADDRESSED = 8, 0.25, 1.25

#: Words and automaton states that a task remembers.
MEMO_WORDS, MEMO_STATES = 400_000, 100_000

WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
QUOTES = re.compile("[\"“”„«»‹›]")

#: Words of reporting and of address in the corpus's languages.
REPORTING = frozenset(
    "quote quoted quoting quotes said says saying wrote writes called calling term terms word words phrase slur slurs insult insults defined definition "
    "example mention mentioned reported according zitat zitiert zitierte sagte schrieb wort begriff beleidigung cita citó dijo escribió palabra término "
    "insulto citation cité dit écrit mot terme insulte".split()
)
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted tus su eres".split())


def edits_for(length: int) -> int:
    """Edits that a term of so many letters allows."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Node:
    __slots__ = ("kids", "allowed", "word", "stem", "size")

    def __init__(self) -> None:
        self.kids: dict[str, Node] = {}
        self.allowed = self.size = 0
        self.word = self.stem = 0.0


class Lexicon:
    """Terms in a trie, read by their Levenshtein automata; ``weight(word)`` is 0 or the best term's discounted weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exempt: frozenset[str] = frozenset()) -> None:
        self.root, self.exempt = Node(), exempt
        for terms, kind in ((words, "word"), (stems, "stem")):
            for term, weight in terms.items():
                allowed = edits_for(len(term)) if kind == "word" else 0
                node = self.root
                node.allowed = max(node.allowed, allowed)
                for c in term:
                    node = node.kids.setdefault(c, Node())
                    node.allowed = max(node.allowed, allowed)
                setattr(node, kind, max(getattr(node, kind), weight))
                node.size = len(term)
        self.memo: dict[str, float] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.accepts: list[tuple[float, float]] = []
        self.dead = self.state({}, 0.0)
        self.start = self.state({(self.root, ""): 0}, 0.0)

    def state(self, reached: dict[tuple[Node, str], int], stem: float) -> int:
        """The number of a state: positions with fewest edits, closed under letters that the word leaves out."""
        todo = list(reached.items())
        while todo:
            (node, owed), spent = todo.pop()
            if not owed and reached.get((node, owed)) == spent:
                for kid in node.kids.values():
                    if spent + 1 <= kid.allowed and spent + 1 < reached.get((kid, ""), 9):
                        reached[kid, ""] = spent + 1
                        todo.append(((kid, ""), spent + 1))
        key = (frozenset((id(n), owed, e) for (n, owed), e in reached.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append((reached, stem))
            self.moves.append({})
            exact, near = stem, 0.0
            for (node, owed), spent in reached.items():
                if not owed and node.word and spent <= edits_for(node.size):
                    if spent:
                        near = max(near, node.word * (0.6 if spent == 1 else 0.4))
                    else:
                        exact = max(exact, node.word)
            self.accepts.append((exact, near))
        return self.states[key]

    def move(self, at: int, letter: str) -> int:
        """The state after one more letter of the word."""
        reached, stem = self.sets[at]
        after: dict[tuple[Node, str], int] = {}

        def reach(node: Node, owed: str, spent: int) -> None:
            if spent <= node.allowed and spent < after.get((node, owed), 9):
                after[node, owed] = spent

        for (node, owed), spent in reached.items():
            if owed:  # the first of two swapped letters was taken; the other must follow
                if letter == owed:
                    reach(node, "", spent)
                continue
            same = node.kids.get(letter)
            if same is not None:
                reach(same, "", spent)
                if not spent:
                    stem = max(stem, same.stem)
            if spent < node.allowed:
                reach(node, "", spent + 1)  # a letter too many
                for first, kid in node.kids.items():
                    if first != letter:
                        reach(kid, "", spent + 1)  # another letter
                        swapped = kid.kids.get(letter)
                        if swapped is not None:
                            reach(swapped, first, spent + 1)
        to = self.state(after, stem) if after or stem else self.dead
        self.moves[at][letter] = to
        return to

    def weight(self, word: str) -> float:
        known = self.memo.get(word)
        if known is not None:
            return known
        if len(self.sets) > MEMO_STATES:
            self.reset()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        at, dead, moves = self.start, self.dead, self.moves
        for c in word:
            to = moves[at].get(c)
            at = self.move(at, c) if to is None else to
            if at == dead:
                break
        exact, near = self.accepts[at]
        self.memo[word] = found = exact if exact else 0.0 if word in self.exempt else near
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, str, float, str]]:
        """(start, end, word, weight, 'abuse' or 'quoted') of every hit in a whole text."""
        text = (text or "").lower()
        memo, weight = self.memo, self.weight
        words = WORD.findall(text)
        if not any([memo[w] if w in memo else weight(w) for w in words]):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        found = []
        for i, w in enumerate(words):
            value = weight(w)
            if not value:
                continue
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            before = text[spans[max(0, i - WINDOW)][0] : spans[i][0]]
            after = text[spans[i][1] : spans[min(len(words) - 1, i + WINDOW)][1]]
            quoted = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None or any(x in REPORTING for x in near)
            addressed = any(x in ADDRESS for x in near)
            found.append((*spans[i], w, value * (QUOTED if quoted else ADDRESSED if addressed else 1.0), "quoted" if quoted else "abuse"))
        return found

    def features(self, text: str | None) -> list[float]:
        """Summed weights of abuse and of quotation, the largest weight, and the number of distinct words hit."""
        found = self.hits(text)
        abuse = sum(h[3] for h in found if h[4] == "abuse")
        quoted = sum(h[3] for h in found if h[4] == "quoted")
        return [float(np.log1p(abuse)), float(np.log1p(quoted)), max((h[3] for h in found), default=0.0), float(np.log1p(len({h[2] for h in found})))]


#: The weights that a fit is drawn to when labels say little: features, then the constant.
PRIOR = np.array([1.5, 0.3, 0.5, 0.3, -3.5])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 2.0) -> np.ndarray:
    """Weights by Newton's method on the summed logistic loss plus the squared distance from the prior."""
    x = np.c_[np.asarray(x, float).reshape(-1, len(prior) - 1), np.ones(len(y))]
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0.0)  # no hit speaks against toxicity
    return w


class Model:
    """A lexicon and the logistic over its features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.words, self.weights = lexicon, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.words.features(t) for t in texts], float).reshape(-1, len(self.weights) - 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def sketch(words: set[str]) -> str:
    """Nearly equal texts mostly get the same: the two of its long words that hash lowest, or all words of a short text."""
    long = sorted(hashlib.md5(w.encode()).hexdigest() for w in words if len(w) >= 7)[:2]
    return "".join(long) if len(long) == 2 else hashlib.md5(" ".join(sorted(words)).encode()).hexdigest()


def sketched(texts: str) -> Column:
    @F.pandas_udf("string")
    def compute(rows: pd.Series) -> pd.Series:
        return pd.Series([sketch(set(WORD.findall((t or "").lower()))) for t in rows])

    return compute(texts)


def one_of_each(sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, fold) of ``sample`` (doc_id, text, label): one row per label and sketch, the sketch's half."""
    rows = sample.withColumn("sketch", sketched("text")).groupBy("sketch", "label").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return rows.select("row.*", "label", F.pmod(F.crc32(F.col("sketch").cast("binary")), F.lit(2)).cast("int").alias("fold"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, fold, toxic, clean): texts of ``rows`` (text, label, fold) with each word or stem.

    A task counts its own rows before anything is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
                words = set(WORD.findall((text or "").lower()))
                stems = {(w[:n], True) for w in words for n in STEM_SIZES if len(w) > n}
                seen.update((t, s, fold, label > 0.5) for t, s in ({(w, False) for w in words} | stems))
        rows = [(t, s, fold, n if toxic else 0, 0 if toxic else n) for (t, s, fold, toxic), n in seen.items()]
        yield pd.DataFrame(rows, columns=["term", "stem", "fold", "toxic", "clean"])

    counted = rows.select("text", "label", "fold").mapInPandas(count, "term string, stem boolean, fold int, toxic long, clean long")
    return counted.groupBy("term", "stem", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> list:
    """(term, stem, weight) of all terms that mark toxic texts."""
    weight = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    found = counts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("weight", weight)
    need = F.when(F.col("stem"), F.lit(2 * MIN_TEXTS)).otherwise(F.lit(MIN_TEXTS))
    found = found.filter((F.col("toxic") >= need) & (F.col("weight") >= MIN_WEIGHT) & (F.col("toxic") >= 4 * F.col("clean")) & (F.length("term") >= 4))
    return found.select("term", "stem", "weight", "toxic").collect()


def build(rows: list) -> Lexicon:
    """A lexicon of chosen terms. A stem stays only if enough of its words were chosen, and then speaks for all words under it."""
    words = {r["term"]: r["weight"] for r in rows if not r["stem"]}
    under = Counter(w[:n] for w in words for n in STEM_SIZES if len(w) > n)
    stems = {r["term"]: r["weight"] for r in rows if r["stem"] and under[r["term"]] >= MIN_STEM_WORDS}
    return Lexicon(words, stems)


def exempted(lexicon: Lexicon, counts: DataFrame) -> Lexicon:
    """The lexicon with the words of clean texts exempt that only inexact hits would mark."""
    words = lexicon

    @F.pandas_udf("double")
    def weigh(terms: pd.Series) -> pd.Series:
        return pd.Series([words.weight(t) for t in terms], dtype=float)

    clean = counts.filter("not stem and clean > 0").select("term").distinct().withColumn("w", weigh("term")).filter("w > 0")
    lexicon.exempt = frozenset(r["term"] for r in clean.select("term").collect())
    lexicon.memo.clear()
    return lexicon


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the bounded sample. Without labelled rows the lexicon is empty and everything scores as clean."""
    sample = written(labelled_sample(docs, labels, "toxic", rows), "toxic-sample")
    kept = written(one_of_each(sample), "toxic-rows")
    counts = written(term_counts(kept), "toxic-terms")
    size = {(r["toxic"], r["fold"]): r["count"] for r in kept.groupBy((F.col("label") > 0.5).alias("toxic"), "fold").count().collect()}
    half = build(choose_terms(counts.filter("fold = 0"), size.get((True, 0), 0), size.get((False, 0), 0)))
    n_toxic, n_clean = (size.get((toxic, 0), 0) + size.get((toxic, 1), 0) for toxic in (True, False))

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([half.features(t) for t in texts], dtype=object)

    other = sample.withColumn("s", sketched("text")).filter(F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(2)) == 1)
    fitted = other.select(measure("text").alias("x"), "label", "doc_id").toPandas().sort_values("doc_id")
    weights = fit_logistic(np.array(fitted["x"].tolist(), float).reshape(-1, len(PRIOR) - 1), fitted["label"].to_numpy(float))
    return Model(exempted(build(choose_terms(counts, n_toxic, n_clean)), counts), weights)


def score_documents(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` added or replaced; every other column stays.

    Null texts are scored as empty ones; whole texts of any length are read; an empty table gives an empty result.
    """
    words, stems, exempt, weights = _plain(model)

    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(Lexicon(words, stems, exempt), weights)
        for batch in batches:
            yield pd.Series(own.scores(batch.tolist()), dtype=float)

    df, back = apart(df, text_col, score_col)
    return together(df.withColumn(score_col, compute(text_col)), back)


def _plain(model: Model) -> tuple[dict[str, float], dict[str, float], frozenset[str], np.ndarray]:
    """A model's terms as plain dictionaries, which travel to tasks without the trie."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    todo = [("", model.words.root)]
    while todo:
        term, node = todo.pop()
        if node.word:
            words[term] = node.word
        if node.stem:
            stems[term] = node.stem
        todo += [(term + c, kid) for c, kid in node.kids.items()]
    return words, stems, model.words.exempt, model.weights


def toxic_hits(df: DataFrame, model: Model, text_col: str = "text", hits_col: str = "toxic_hits") -> DataFrame:
    """``df`` with the hits of each text: an array of (start, end, word, weight, kind), empty where there are none.

    Null and empty texts have none; whole texts of any length are read; repeated rows get equal hits, an empty table gives
    an empty result, and every other column stays.
    """
    words, stems, exempt, _ = _plain(model)

    @F.pandas_udf("array<struct<start:int,end:int,word:string,weight:double,kind:string>>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(words, stems, exempt)
        for batch in batches:
            yield pd.Series([[dict(zip(("start", "end", "word", "weight", "kind"), h, strict=True)) for h in own.hits(t)] for t in batch.tolist()], dtype=object)

    df, back = apart(df, text_col, hits_col)
    return together(df.withColumn(hits_col, compute(text_col)), back)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``cut``, with their columns as they were.

    Null texts count as empty ones, which score as clean ones do; of repeated rows all stay or none; an empty table gives
    an empty result.
    """
    mark = free_name(df, "toxicity_score")
    return score_documents(df, model, text_col, mark).filter(F.col(mark) < cut).drop(mark)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a lexicon learned from labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


SQL: dict[str, str] = {}
