"""Runs of periodic words in a text, by seeds on diagonals that are extended once.

A word is ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest
period q (words q apart are the same) that no neighbouring word extends, of at
least ``least`` words and ``power`` periods.

Seeds.  A run of period q repeats at lag q for ``max(least, power * q) - q``
words or more, so it holds two equal k-grams at that lag for every k up to this
guaranteed overlap.  Periods up to the smallest overlap k0 (16 for 24 and 3) are
looked for with k0-grams, those in (k/2, k] with k-grams for k = 2 k0, 4 k0, ...
As k >= q and no part of the run has a smaller period, the occurrence of a
k-gram that follows the one at i in the same text is the one at i + q: only
neighbouring occurrences are paired, one pair for every position and level,
never all pairs of a frequent gram.  A pair of a lag that is no smallest period
cannot arise inside a run of a smaller one.

Extension.  Pairs are taken by lag and position; each is extended to both sides
along its diagonal, and the furthest word that the lag has covered lets the
pairs under it go.  k-grams are named by exact ranks made by doubling; a text
without repeated k0-gram (by hash) is left before that.

Nulls and texts without words have no runs and an empty collapsed text.  A text
of any length is read whole, in pieces of about a megabyte; beside the text it
takes some arrays of a number for each word.  Ties do not arise, as runs differ
in start or period; repeated rows give repeated results; an empty table gives
an empty table; columns of the input with the names of the new ones are
replaced unless ``prefix`` keeps them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import prepare, text_column, with_text_column

LEAST = 24
POWER = 3
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            # a piece ends before a space, or takes in the rest of a longer word
            blank = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if blank <= at:
                after = [p for p in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                blank = min(after, default=len(data))
            end = blank
        yield data[at:end].split()
        at = end


def word_numbers(text: str | None) -> np.ndarray:
    """The words of a text as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    parts = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words)) for words in _pieces(text)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def seed_width(least: int = LEAST, power: int = POWER) -> int:
    """Words at which every run of any period is sure to repeat."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def may_repeat(numbers: np.ndarray, width: int) -> bool:
    """Whether two ``width``-grams have the same hash; equal grams always do."""
    if len(numbers) <= width:
        return False
    hashes, size = _scattered(numbers.astype(np.uint64)), 1
    while size < width:
        step = min(size, width - size)
        hashes = _scattered(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:])
        size += step
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def _ranks(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the grams made of two, ``step`` apart."""
    return np.unique(ranks[:-step] << 32 | ranks[step:], return_inverse=True)[1].astype(np.int64)


def _neighbours(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of every gram that occurs again, to its next occurrence."""
    order = np.argsort(ranks, kind="stable")
    again = ranks[order[1:]] == ranks[order[:-1]]
    return order[:-1][again], (order[1:] - order[:-1])[again]


def _reach(numbers: np.ndarray, at: int, lag: int, forward: bool) -> int:
    """How many words from ``at`` on (or before it) equal those ``lag`` further."""
    room, found, step = (len(numbers) - lag - at if forward else at), 0, 64
    while found < room:
        size = min(step, room - found)
        lo = at + found if forward else at - found - size
        same = numbers[lo : lo + size] == numbers[lo + lag : lo + lag + size]
        if not same.all():
            return found + int(np.argmin(same if forward else same[::-1]))
        found, step = found + size, step * 2
    return found


def find_runs(numbers: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ascending."""
    if power < 3 or least < power:
        raise ValueError("runs need power >= 3 and least >= power")
    width = seed_width(least, power)
    if not may_repeat(numbers, width):
        return []
    ranks, size, found = np.unique(numbers, return_inverse=True)[1].astype(np.int64), 1, []
    while size < width:
        step = min(size, width - size)
        ranks, size = _ranks(ranks, step), size + step
    shortest = 1
    while power * shortest <= len(numbers):
        places, lags = _neighbours(ranks)
        if not len(places):
            break  # a longer gram that repeats would begin with one of these
        wanted = (lags >= shortest) & (lags <= size)
        places, lags = places[wanted], lags[wanted]
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        covered: dict[int, int] = {}
        i = 0
        while i < len(places):
            lag, place = int(lags[i]), int(places[i])
            if place < covered.get(lag, 0):
                # on to the first pair of this lag that is not covered yet
                end = int(np.searchsorted(lags, lag, side="right"))
                i += int(np.searchsorted(places[i:end], covered[lag]))
                continue
            start = place - _reach(numbers, place, lag, False)
            stop = place + _reach(numbers, place, lag, True)
            covered[lag] = stop
            if stop - start + lag >= max(least, power * lag):
                found.append((start, stop - start + lag, lag))
            i += 1
        shortest = size + 1
        if power * shortest > len(numbers) or len(ranks) <= size:
            break
        ranks, size = _ranks(ranks, size), 2 * size
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(n_words: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those of a run after its first period."""
    kept = np.ones(n_words, dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def _worker(least: int, power: int):
    def work(texts: list[str | None]) -> dict[str, list]:
        made: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
        for text in texts:
            numbers = word_numbers(text)
            runs = find_runs(numbers, least, power)
            kept, at, parts = kept_words(len(numbers), runs), 0, []
            for words in _pieces(text):
                if runs:
                    stays = kept[at : at + len(words)].tolist()
                    at += len(words)
                    words = [w for w, s in zip(words, stays) if s]
                if words:
                    parts.append(b" ".join(words))
            made["n_words"].append(len(numbers))
            made["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            made["collapsed"].append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        return made

    return work


def with_runs(df: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER, prefix: str = "") -> DataFrame:
    """``df`` with n_words, runs (by start, then period) and collapsed: the words that no run repeats, joined by spaces."""
    prepare(df.sparkSession)
    return with_text_column(df, text_column(FIELDS, _worker(least, power)), text, ["n_words", "runs", "collapsed"], prefix)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period (ties: smallest start, then period); null without runs."""

    def better(best: Column, run: Column) -> Column:
        # runs come by start, then period, so an equal one does not replace
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def listed(runs: Column) -> Column:
    """The runs as lines of start, length and period."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def damaged(doc_id: Column, text: Column) -> Column:
    """A text in which, for every tenth id by crc32, a tail of the words repeats its beginning; others are unchanged.

    A null id leaves its text unchanged.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    tail = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)
