"""Periodic runs against a plain search over all lags."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import periodic_runs
from labelmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    border = [0] * len(words)
    for i in range(1, len(words)):
        k = border[i - 1]
        while k and words[i] != words[k]:
            k = border[k - 1]
        border[i] = k + (words[i] == words[k])
    return len(words) - border[-1]


def plain_runs(words, least=24, power=3):
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, power * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *top, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 60)), min_size=1, max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [w for block, length in blocks for w in (block * (length // len(block) + 1))[:length]]
    assert periodic_runs.find_runs(np.array(words, dtype=np.int64)) == plain_runs(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300))
def test_runs_of_two_words(words):
    assert periodic_runs.find_runs(np.array(words, dtype=np.int64)) == plain_runs(words)


@pytest.mark.parametrize("least,power", [(24, 3), (10, 4), (3, 3), (50, 5)])
@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 100, 129])
def test_every_period_at_its_shortest_length(period, least, power):
    rng = np.random.default_rng(period)
    unit = rng.permutation(period)
    shortest = max(least, power * period)
    for length, hits in ((shortest, 1), (shortest - 1, 0)):
        head, tail = 1000 + rng.permutation(40), 2000 + rng.permutation(40)
        words = np.concatenate([head, np.resize(unit, length), tail])
        found = periodic_runs.find_runs(words, least, power)
        if not (found == [] and hits == 0):
            assert found == plain_runs(list(words), least, power)
        assert ((40, length, period) in found) == bool(hits)


def test_a_run_longer_than_a_piece():
    text = "ab cd ef " * 300_000 + "x" * 2_000_000 + " y"
    numbers = periodic_runs.word_numbers(text)
    assert len(numbers) == 900_002
    assert periodic_runs.find_runs(numbers) == [(0, 900_000, 3)]


def test_pieces_cut_words_nowhere(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    text = "a  bb\tccc\x0bdddd\x0ceeeeeeeeeeeeeeee\rf\x1cg\x85h\xa0i\n\n jj"
    assert [w.decode() for p in periodic_runs._pieces(text) for w in p] == WORD.findall(text)


def test_the_query_is_the_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()]
    plain = [plain_row(*d) for d in docs if len(d["text"] or "") < 20_000]
    short = {r[0] for r in plain}
    assert sorted(r for r in found if r[0] in short) == sorted(plain)
    assert len(found) == len(docs) and sum(r[1] > 0 for r in found) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.withColumn("runs", odd_docs["text"]).withColumnRenamed("n_chars", "n_words")
    found = periodic_runs.with_runs(rows).collect()
    for r in found:
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r["runs"]] == plain_runs(words)
            assert r["collapsed"] == (" ".join(words) if not r["runs"] else r["collapsed"])
    long = next(r for r in found if r["doc_id"] == 6)
    assert [tuple(x) for x in long["runs"]] == [(0, 40_000, 1)] and long["collapsed"] == "word " + "x" * 30_000
    assert len(found) == odd_docs.count()
    assert "_runs" in periodic_runs.with_runs(rows, prefix="_").columns
    assert periodic_runs.with_runs(no_docs).count() == 0
