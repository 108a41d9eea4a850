import hashlib

import numpy as np

from labelmill.llm import syncmers as sy


def plain_anchors(text):
    grams = sy._grams(np.array([ord(c) for c in text], dtype=np.uint64), None, sy.S) if len(text) >= sy.S else []
    out = []
    for i in range(len(text) - sy.K + 1):
        inner = [int(x) for x in grams[i : i + sy.K - sy.S + 1]]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


TEXTS = ["", "short", "a" * 40, "The quick brown fox jumps over the lazy dog", "é日本語😀 " * 9, "exactly12chr"]


def test_anchors_equal_plain_ones():
    owner, at, _ = sy.syncmers(TEXTS)
    for i, text in enumerate(TEXTS):
        expected = plain_anchors(text) if len(text) >= sy.K else [0] * bool(text)
        assert at[owner == i].tolist() == expected


def test_anchors_do_not_depend_on_what_surrounds_them():
    passage = "some passage that occurs in two places, unchanged"
    marks = []
    for before in ("", "something else before it "):
        _, at, hashes = sy.syncmers([before + passage + before])
        inside = [(p - len(before), h) for p, h in zip(at, hashes) if len(before) <= p <= len(before) + len(passage) - sy.K]
        marks.append(inside)
    assert marks[0] == marks[1] and marks[0]


def test_positions_as_rows(spark, odd_docs):
    rows = sy.anchors(odd_docs.filter("doc_id in (1, 2, 3)")).collect()
    text = odd_docs.filter("doc_id = 1").first()["text"]
    assert sorted(r["position"] for r in rows) == sorted(plain_anchors(text) * 2)


def plain_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = sy.sketches([t, edited, n])
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sy.as_text(a), sy.as_text(b), sy.likeness(a, b), sy.likeness(a, c))


def test_edited_texts_equal_plain_ones(spark, odd_docs, no_docs, sf_dir, monkeypatch):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows_of_a_span in (2000, 7):
        monkeypatch.setattr(sy, "SPAN_ROWS", rows_of_a_span)
        rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
        assert sorted(map(tuple, sy.edited_likeness(documents).collect())) == sorted(plain_rows(rows))
    # equal ids have no order of their own: leave one row of each
    odd = odd_docs.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert sorted(map(tuple, sy.edited_likeness(odd).collect()), key=str) == sorted(plain_rows(rows), key=str)
    assert sy.edited_likeness(odd_docs).count() == 10
    assert sy.edited_likeness(no_docs).count() == 0
    alone = sy.edited_likeness(documents.limit(1)).first()
    assert alone["near_next"] == 1.0


def test_likeness_follows_the_share_of_common_text():
    rng = np.random.default_rng(0)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    a, b = words(500), words(500)
    half = len(a) // 2
    one, mixed, other = sy.sketches([a, a[:half] + b[:half], b])
    assert sy.likeness(one, one) == 1 and sy.likeness(one, other) < 0.05 and 0.15 < sy.likeness(one, mixed) < 0.55
