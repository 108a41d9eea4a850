"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

The symbols of a word form a linked list.  A heap holds the known adjacent
pairs by rank and place; the lowest is popped, checked against the list as it
stands, merged, and its two new neighbour pairs are pushed.  A word's count is
its number of bytes minus its number of merges, so a word costs O(n log n)
however long it is.

Null texts count as empty: 0 bytes, 0 tokens.  Strings of added tokens inside
a text count as one token each, as the library does by default.  Equal rows
give equal results, null keys are kept, an empty table gives an empty table,
and clashing extra columns are replaced.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from labelmill.llm.common import prepare, text_column, with_text_column
from labelmill.llm.numpy_bpe import byte_characters

#: Words that a task remembers; then it starts anew.
CACHED_WORDS = 400_000


class TokenCounter:
    """Counts for byte-level vocabularies without word ends."""

    #: How this kind of vocabulary splits text.
    WORDS = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
    )

    def __init__(self, content: str):
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.symbols = [ids[c] for c in byte_characters()]
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in spec["added_tokens"]) or r"(?!)")
        self.cache: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        n = len(symbols)
        if n < 2:
            return n
        ranks, after, before = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := ranks.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := ranks.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1], made, symbols[k]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], made))
        return n - merges

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        total, cache = len(parts) - 1, self.cache
        for part in parts:
            for word in self.WORDS.findall(part):
                n = cache.get(word)
                if n is None:
                    n = self.count_word(word)
                    if len(word) <= 64:
                        cache[word] = n
                total += n
        if len(cache) > CACHED_WORDS:
            cache.clear()
        return total


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of every whole text.

    ``vocabulary`` is the path of a tokenizer file; its content is broadcast (its size is that of the file).
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def count(texts: list[str | None], counter: TokenCounter) -> dict[str, list]:
        n = [counter.count(t) if t else 0 for t in texts]
        return {
            "n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts],
            "n_tokens": n,
            "over_limit": [x > limit for x in n],
        }

    column = text_column(
        "n_bytes long, n_tokens long, over_limit boolean", count, lambda: TokenCounter(content.value)
    )
    return with_text_column(docs, column, text, ["n_bytes", "n_tokens", "over_limit"])
