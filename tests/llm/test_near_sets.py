"""The near-duplicate stage against all pairs of shingle sets."""

import numpy as np
import pytest

import corpus_pipeline as cp
from labelmill.llm import near_sets as ns


def plain_set(text):
    words = (text or "").encode("utf-8").lower().split()
    size = min(ns.WORDS, len(words))
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def plain_kept(rows):
    """Smallest ids of the groups."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0:
                root[find(i)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(i, first.get(find(k), i))
    return sorted(first.values())


def copies():
    """Texts with one to twelve words changed, and a chain of them."""
    rng, rows = np.random.default_rng(0), []
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    for size in (60, 200):
        for changed in (1, 2, 4, 6, 12):
            for _ in range(6):
                words = [word() for _ in range(size)]
                rows.append(" ".join(words))
                for at in rng.integers(0, size, changed):
                    words[at] = word()
                rows.append(" ".join(words))
    words = [word() for _ in range(100)]
    for at in range(0, 100, 2):
        words[at] = word()
        rows.append(" ".join(words))
    return [*enumerate(rows), (5000, None), (5001, " \n"), (5002, rows[0]), (5003, rows[0].upper())]


def crowd():
    """Copies of one text with one to seven edits: a band brings them together, pairs of them are alike by 0.5 to 1."""
    rng, rows = np.random.default_rng(1), []
    base = [f"w{i}" for i in range(120)]
    for _ in range(400):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 8)):
            kind = rng.integers(0, 3)
            words[at] = ["", f"{words[at]} x", f"y{rng.integers(0, 3)}"][kind]
        rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("made,small", [(copies, 0), (copies, 8), (crowd, 0)])
def test_near_copies_go(spark, monkeypatch, made, small):
    """However many texts of a leader are paired, the groups are those of all pairs."""
    monkeypatch.setattr(ns, "SMALL", small)
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == plain_kept(made())


def test_a_crowd_is_not_paired(spark, monkeypatch):
    """Candidates of a large group whose texts share bands are far fewer than its pairs."""
    made = []
    whole = ns._candidates
    monkeypatch.setattr(ns, "_candidates", lambda *a: made.append(whole(*a)) or made[-1])
    docs = crowd()
    ns.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert 0 < made[0].count() < 0.05 * len(docs) ** 2 / 2


def test_documents_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in ns.one_of_each(docs).collect()) == plain_kept(rows)
    assert ns.one_of_each(odd_docs).columns == odd_docs.columns
    # 1, the wordless 2 to 4, 5, 6, both texts of 7, the row without an id
    assert sorted(str(r["doc_id"]) for r in ns.one_of_each(odd_docs).collect()) == ["1", "2", "5", "6", "7", "7", "None"]
    assert ns.one_of_each(no_docs).count() == 0


def test_texts_of_any_script_are_compared_by_words(spark):
    """Case, white space and scripts without spaces are Unicode's, so copies that differ in them or in a word go."""
    accented = " ".join(f"é{i}ß Ünter{i % 7} žá{i}" for i in range(40))
    unspaced = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(300))
    rows = [
        (1, accented), (2, accented.upper()), (3, accented.replace(" ", " ")), (4, accented.replace(" ", "　").title()),
        (5, unspaced), (6, unspaced[:150] + "あ" + unspaced[151:]), (7, unspaced[:20] + "x" * 300),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ns.one_of_each(docs).collect()) == [1, 5, 7]


def test_sets_of_near_simhashes_are_linked(spark):
    """Pairs of sets within two bits are linked by their SimHashes, sets of one SimHash through the smallest; null ones are not."""
    prints = [(1, 0), (2, 0b11), (3, 0b111), (4, 1 << 40), (5, 0), (6, None), (7, -1), (8, None)]
    found = {tuple(sorted(r)) for r in ns._by_prints(spark.createDataFrame(prints, "set_id long, print long")).collect()}
    assert found == {(1, 2), (1, 4), (1, 5), (2, 3)}
