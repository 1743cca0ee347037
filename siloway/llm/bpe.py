"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

A batch's texts are cut at white space into chunks, the chunks not met lately into words by the vocabulary's pattern, and
the distinct words are inserted into a trie. The walk keeps, for each prefix on the way, the last token of the prefix's
own encoding. That state is found from shorter prefixes alone: the last token t of a prefix is the one ending there that
may follow the last token u of the prefix before it, which holds just when the encoding of u's text followed by t's is
[u, t]. So every prefix that words share is worked out once, and a word's tokens are read off backwards. The last symbol
of a word carries the end-of-word mark and so is looked up apart from the same symbol inside words.

Results are those of the tokenizers library with special tokens left out of encoding but recognised in texts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloway.llm.common import apart, free_name, table, together

#: Chunks (in each of two generations) and words remembered, words in a trie, and token pairs whose check is remembered.
MEMO_CHUNKS, MEMO_WORDS, TRIE_WORDS, MEMO_PAIRS = 120_000, 80_000, 40_000, 150_000

#: Rows that are encoded at once; only they leave Arrow's memory.
BATCH_ROWS = 500

#: The Unicode White_Space characters; str.split() also cuts at the four controls in NOT_SPACE.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_SPACE = "\x1c\x1d\x1e\x1f"

def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def joined(entries: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """The entry of consecutive stretches of text: decoding joins tokens by a space, so decoded stretches do too."""
    return sum([e[0] for e in entries]), " ".join([e[1] for e in entries]), " ".join([e[2] for e in entries])


class Encoder:
    """Encodes and decodes with the vocabulary, merges and special tokens of a tokenizer file (BPE with word ends)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", SPACE), regex.V0)
        self.chunks = regex.compile(f"[^{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.byte_chars = byte_chars()
        self.size = {t: len(t.removesuffix(self.suffix)) for t in self.vocab}
        inner = {t.removesuffix(self.suffix) for t in self.vocab}
        self.starts = {t[:n] for t in inner for n in range(1, len(t) + 1)}
        self.moves: dict[str, str] = {}
        self.inner: dict[str, list] = {}
        self.ends: dict[str, list] = {}
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.checked = 0

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token was merged from; the last may carry the end-of-word mark."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            inner = token.removesuffix(self.suffix)
            return [*inner[:-1], inner[-1] + self.suffix]
        return [*token]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked neighbours merge first, the leftmost of equals."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def check(self, before: str, token: str, after: dict[str, bool]) -> bool:
        """Whether ``before`` and then ``token`` is the encoding of their text (``before`` empty: of the token's own)."""
        if self.checked >= MEMO_PAIRS:
            for known in self.follows.values():
                known.clear()
            self.checked = 0
        parts = [before, token] if before else [token]
        self.checked += 1
        after[before] = ok = self.merged([s for p in parts for s in self.symbols(p)]) == parts
        return ok

    def move(self, state: str, char: str) -> str:
        """The longest end of state + char that some token begins with."""
        longer = tail = state + char
        while tail and tail not in self.starts:
            tail = tail[1:]
        self.moves[longer] = tail
        return tail

    def ending(self, state: str, suffix: str) -> list[tuple[int, str, dict[str, bool]]]:
        """(length, token, what is known of its predecessors) of the tokens that a state ends with, the longest first."""
        tokens = [state[i:] + suffix for i in range(len(state)) if state[i:] + suffix in self.vocab]
        found = [(self.size[t], t, self.follows.setdefault(t, {})) for t in tokens]
        (self.ends if suffix else self.inner)[state] = found
        return found

    def walk(self, words: set[str]) -> dict[str, tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each word in byte characters.

        The trie is held as its words in order: neighbours share their path from the root up to the first character that
        differs, so taking them one by one walks the trie depth first, and ``last`` holds the last tokens of the path's
        prefixes. States below a word's parent are left to the words that go through them.
        """
        found: dict[str, tuple[int, str, str]] = {}
        last, states, before = [""], [""], ""
        moves, inner, ends, vocab, size, suffix = self.moves, self.inner, self.ends, self.vocab, self.size, self.suffix
        for word in sorted(words):
            depth = len(word)
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            at = len(last)
            state = states[-1]
            for char in word[at - 1 :]:
                to = moves.get(state + char)
                state = self.move(state, char) if to is None else to
                if at == depth:
                    options = ends.get(state) or self.ending(state, suffix)
                else:
                    options = inner.get(state) or self.ending(state, "")
                for n, token, after in options:
                    ok = after.get(last[at - n])
                    if ok or ok is None and self.check(last[at - n], token, after):
                        break
                else:
                    raise ValueError(f"no token ends {word[:at]!r}")
                if at < depth:
                    last.append(token)
                    states.append(state)
                at += 1
            at, ids = depth, []
            while True:
                ids.append(vocab[token])
                at -= size[token]
                if not at:
                    break
                token = last[at]
            ids.reverse()
            found[word], before = self.entry(ids), word
        return found

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each chunk, from tries of a bounded number of words."""
        encoded: dict[str, tuple[int, str, str]] = {}
        cut: dict[str, list[str]] = {}
        words: set[str] = set()
        chars, memo = self.byte_chars, self.memo

        def flush() -> None:
            if len(memo) + len(words) > MEMO_WORDS:
                memo.clear()
                words.update(w for parts in cut.values() for w in parts)
            memo.update(self.walk(words))
            for c, parts in cut.items():
                if len(parts) == 1:
                    encoded[c] = memo[parts[0]]
                else:
                    encoded[c] = joined([memo[w] for w in parts])
            cut.clear()
            words.clear()

        for c in chunks:
            parts = [c] if c.isascii() and c.isalpha() else self.words.findall(c)
            if not (c.isascii() and c.isprintable()):
                parts = ["".join([chars[b] for b in w.encode("utf-8", "surrogatepass")]) for w in parts]
            cut[c] = parts
            words.update([w for w in parts if w not in memo])
            if len(words) >= TRIE_WORDS:
                flush()
        flush()
        return encoded

    def pieces(self, text: str) -> list[str]:
        """The normalised chunks of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letter by letter, not the form at the end of a word
            text = text.replace("Σ", "σ")
        text = text.lower()
        return self.chunks.findall(text) if any(c in text for c in NOT_SPACE) else text.split()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of every whole text; null counts as the empty text."""
        parts: list[list[str]] = []
        new: set[str] = set()
        young = self.young
        for text in texts:
            own = []
            for piece in self.cut.split(text) if text and "<|" in text else [text or ""]:
                own += [piece] if piece in self.special else self.pieces(piece)
            parts.append(own)
            new.update(own)
        new.difference_update(young)
        if len(young) + len(new) > MEMO_CHUNKS:
            self.old, self.young = young, {}
            young = self.young
            new = {c for own in parts for c in own}
        old = self.old
        young.update((c, old[c]) for c in new if c in old)
        young.update((s, self.entry([i])) for s, i in self.special.items() if s in new)
        young.update(self.learn({c for c in new if c not in young}))
        for own in parts:
            yield joined([young[c] for c in own])

    def forget(self) -> None:
        """Drop the chunks of texts that are remembered; the vocabulary and what is known of words stay."""
        self.young.clear()
        self.old.clear()

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings joined by one space: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        """What is remembered of ids: their number, themselves as text, and their decoding."""
        return len(ids), " ".join(map(str, ids)), self.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(df: DataFrame, path: str, text_col: str = "text", ids: bool = True, digests: bool = True, hold: bool = True) -> DataFrame:
    """``df`` with the encoding of each whole text (null: empty) added; every other column stays.

    Adds ``n_tokens``; with ``ids`` also ``token_ids`` (array<int>); with ``digests`` also ``ids_sha256`` (of the decimal
    ids joined by one space) and ``decoded_sha256`` (of the decoded text in UTF-8). Columns of these names in ``df`` are
    replaced. Texts are encoded whole at any length, an empty text to no tokens; repeated rows are encoded alike and an
    empty table gives an empty result. Without ``hold``, workers drop the vocabulary and all that they know of words when a task
    ends, so that they are small again for the steps after this one.
    """
    kinds = {"n_tokens": pa.int64()} | ({"token_ids": pa.list_(pa.int32())} if ids else {})
    kinds |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {}
    ddl = {"n_tokens": "long", "token_ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    df, back = apart(df, text_col, *kinds)
    kept = [c for c in df.columns if c not in kinds]
    out = free_name(df, "encoded")

    @F.arrow_udf(", ".join(f"{name} {ddl[name]}" for name in kinds))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in batches:
            for start in range(0, len(batch), BATCH_ROWS):
                made: dict[str, list] = {name: [] for name in kinds}
                for n, id_text, decoded in own.encode(batch.slice(start, BATCH_ROWS).to_pylist()):
                    made["n_tokens"].append(n)
                    if ids:
                        made["token_ids"].append(pa.array([*map(int, id_text.split())], pa.int32()))
                    if digests:
                        made["ids_sha256"].append(hashlib.sha256(id_text.encode()).hexdigest())
                        made["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                arrays = [listed(made[name]) if pa.types.is_list(kind) else pa.array(made[name], kind) for name, kind in kinds.items()]
                yield pa.StructArray.from_arrays(arrays, [*kinds])
        own.forget()  # workers live on; what they remember would stay with them
        if not hold:
            del own
            encoder.cache_clear()
            gc.collect()

    return together(df.select(*kept, encode(text_col).alias(out)).select(*kept, f"{out}.*"), back)


def listed(arrays: list[pa.Array]) -> pa.Array:
    """The arrays of numbers as one array of lists."""
    ends = [0]
    for a in arrays:
        ends.append(ends[-1] + len(a))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.int32()), *arrays]))


def decode_documents(df: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded_text``, the decoding of ``ids_col`` (null or empty: the empty text), added or replaced.

    Every other column stays; repeated rows are decoded alike and an empty table gives an empty result. An id that the
    vocabulary lacks fails the job.
    """
    df, back = apart(df, ids_col, "decoded_text")

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in batches:
            yield pa.array([own.decode(ids or []) for ids in batch.to_pylist()], pa.string())

    return together(df.withColumn("decoded_text", decode(ids_col)), back)


def default_tokenizer() -> str:
    """The place of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded: its number of tokens, and digests of ids and decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, default_tokenizer(), ids=False).drop("text")


SQL: dict[str, str] = {}
