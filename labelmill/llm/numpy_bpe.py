"""Byte-pair encoding and decoding by batched numpy merge rounds.

All words of a batch that were not seen before lie in one flat symbol array.
A round looks every adjacent pair up by binary search in the sorted pair keys,
takes each word's lowest rank, and merges all its occurrences from left to
right.  Words without a known pair leave the array.

Merging all occurrences of the lowest pair at once equals merging one by one
as long as a token is used by later merges only than those that make it; the
vocabulary is checked for that when it is loaded, and where it does not hold
only the leftmost occurrence is merged in a round.

Null texts count as empty; an empty text has no ids and decodes to ''.  Equal
rows give equal results, null keys are kept as they are, an empty table gives
an empty table, and clashing extra columns are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from labelmill.llm.common import prepare, text_column, with_text_column

#: Words that a task remembers; then it starts anew.
CACHED_WORDS = 200_000
#: Characters of the texts whose new words share merge rounds.
BLOCK_CHARS = 1 << 20
NEVER = np.int32((1 << 31) - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in ascending order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, as arrays: bytes' symbols, sorted pair keys, ranks and merged ids."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, ids = spec["model"], spec["model"]["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_characters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + self.suffix] for c in letters], dtype=np.int64)
        self.width = np.int64(max(self.tokens) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(left * self.width + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.width + right)[order], order.astype(np.int32), made[order]
        # the last rank that makes a token must come before the first that uses it
        ranks, makes, uses = np.arange(len(pairs)), np.full(self.width, -1), np.full(self.width, NEVER)
        np.maximum.at(makes, made, ranks)
        np.minimum.at(uses, left, ranks)
        np.minimum.at(uses, right, ranks)
        self.ordered = bool((makes < uses).all())

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word.

        The rank of every adjacent pair is kept; a round looks up only those
        that its merges changed, so that a very long word costs little a round.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.inner[np.frombuffer(b"".join(words), dtype=np.uint8)]
        symbols[np.cumsum(sizes) - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), dtype=np.int32)
        self._look_up(np.arange(len(symbols)), symbols, owner, rank, made)
        done: list[np.ndarray | None] = [None] * len(words)
        while len(symbols):
            starts = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            if (best == NEVER).any():
                for g in np.flatnonzero(best == NEVER):
                    done[owner[starts[g]]] = symbols[starts[g] : starts[g] + sizes[g]].copy()
                stay = np.repeat(best != NEVER, sizes)
                symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
                best, sizes = best[best != NEVER], sizes[best != NEVER]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[_non_overlapping(at) if self.ordered else np.diff(owner[at], prepend=-1) != 0]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
            at -= np.arange(len(at))  # every merge before it took a symbol away
            self._look_up(np.unique(np.concatenate([at, np.maximum(at - 1, 0)])), symbols, owner, rank, made)
        return done

    def _look_up(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Set rank (NEVER for an unknown one) and outcome of the pairs that begin at ``at``."""
        rank[at] = NEVER
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        keys = symbols[at] * self.width + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[found] == keys
        rank[at[hit]], made[at[hit]] = self.ranks[found[hit]], self.made[found[hit]]


def _non_overlapping(at: np.ndarray) -> np.ndarray:
    """Of ascending pair positions, every other one of each run of neighbours."""
    index = np.arange(len(at))
    opens = np.diff(at, prepend=-2) != 1
    return (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0


class WordEncoder:
    """Whole-text encoding for vocabularies with word ends: NFC, white space, lower case, words, merges.

    Strings of added tokens are cut out of the raw text first.
    """

    #: How this kind of vocabulary splits text.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")")
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _lower(text: str) -> str:
        # one character at a time where the whole string's case mapping looks at neighbours
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _words(self, text: str) -> list[str]:
        """Words in order; added tokens stay as they are, marked by a leading NUL."""
        if not any(s in text for s in self.vocabulary.special):
            return self.WORDS.findall(self._lower(unicodedata.normalize("NFC", text)))
        out = []
        for n, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if n % 2 else self.WORDS.findall(self._lower(unicodedata.normalize("NFC", part)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        if not self.cache:
            self.cache.update({"\0" + s: np.array([i], dtype="<u4").tobytes() for s, i in self.vocabulary.special.items()})
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BLOCK_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            words = [self._words(t or "") for t in texts[lo:hi]]
            unknown = list(set(chain.from_iterable(words)) - self.cache.keys())
            for at in range(0, len(unknown), 50_000):
                some = unknown[at : at + 50_000]
                merged = self.vocabulary.merge([w.encode("utf-8") for w in some])
                self.cache.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(some, merged))
            out += [b"".join(map(self.cache.__getitem__, w)) for w in words]
            lo = hi
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens with single spaces between them, as such files name no decoder."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def with_encoding(docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    ``ids`` adds token_ids (binary: little-endian unsigned 32-bit integers), ``decoded`` adds decoded_text.
    ``vocabulary`` is the path of a tokenizer file; its content is broadcast (its size is that of the file).
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {"token_ids": "binary"} if ids else {}
    kinds |= {"decoded_text": "string"} if decoded else {}

    def encode(texts: list[str | None], encoder: WordEncoder) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in kinds}
        for coded in encoder.encode(texts):
            back = encoder.decode(coded)
            row = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())
            for k, v in zip(kinds, row):
                out[k].append(v)
            if ids:
                out["token_ids"].append(coded)
            if decoded:
                out["decoded_text"].append(back)
        return out

    column = text_column(", ".join(f"{k} {v}" for k, v in kinds.items()), encode, lambda: WordEncoder(content.value))
    return with_text_column(docs, column, text, list(kinds))


def decode_ids(df: DataFrame, vocabulary: str, column: str = "token_ids") -> DataFrame:
    """``df`` with decoded_text of a binary column of ids; null ids decode to null."""
    spark: SparkSession = prepare(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = WordEncoder(content.value)
        for batch in batches:
            yield pd.Series([None if b is None else encoder.decode(b) for b in batch.tolist()], dtype=object)

    return df.withColumn("decoded_text", decode(column))
