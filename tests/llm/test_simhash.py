import random
import re

import numpy as np
import xxhash

from labelmill.llm import golay_simhash as gs
from labelmill.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    """By fingerprint: the smallest fingerprint that is reachable by links of at most two bits."""
    todo, out = sorted(set(prints)), {}
    for p in todo:
        if p in out:
            continue
        reached, stack = {p}, [p]
        while stack:
            x = stack.pop()
            near = [y for y in todo if y not in reached and (x ^ y).bit_count() <= 2]
            reached.update(near)
            stack += near
        out |= dict.fromkeys(reached, min(reached))
    return out


def unsigned(x):
    return x & (1 << 64) - 1


def noisy_prints(seed, centres=12, around=25):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(around):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            out.append(x)
    return out


def test_golay_code_is_perfect():
    table = gs._nearby()
    assert sorted(int(x) for x in table[:, 0]) == sorted(sum(1 << b for b in c) for n in range(4) for c in gs.combinations(range(23), n))
    assert (table[:, 1:] > 0).sum() == 8855  # all patterns of four errors
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    near = gs.codewords(words)
    decoded = words ^ table[gs.syndromes(words), 0]
    assert (gs.syndromes(decoded) == 0).all() and (decoded >> 11 == near[:, 0]).all()


def test_all_pairs_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3, dtype=np.uint64)
    for x in a:
        flips = [0] + [1 << i | 1 << j for i in range(64) for j in range(i, 64)]
        y = np.array([int(x) ^ f for f in flips], dtype=np.uint64)
        nearest, _ = gs.keys(np.full(len(y), x))
        _, listed = gs.keys(y)
        assert ((nearest[:, :, None] == listed) & (listed >= 0)).any(axis=(1, 2)).all()


def test_fingerprints_equal_plain_ones(odd_docs, spark, sf_dir):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)):
        for r in gs.with_fingerprint(docs.select("doc_id", "text", "source")).collect():
            assert unsigned(r["fingerprint_bits"]) == plain_fingerprint(r["text"])


def test_links_have_the_components_of_all_pairs(spark):
    prints = noisy_prints(3)
    expected = plain_components(prints)
    frame = spark.createDataFrame([(gs._signed(p),) for p in set(prints)], "fp long")
    for bucket in (64, 0):  # by pairs, and by midpoints alone
        found = components(gs.links(frame, bucket), "a", "b").collect()
        grouped = {}
        for r in found:
            grouped.setdefault(r["component"], set()).add(unsigned(r["node"]))
        plain = {}
        for p, root in expected.items():
            plain.setdefault(root, set()).add(p)
        assert sorted(map(sorted, grouped.values())) == sorted(sorted(v) for v in plain.values() if len(v) > 1)


def test_documents_and_their_components(spark, odd_docs, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (odd_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r["text"]) for r in rows]
        root = plain_components(prints)
        least = {}
        for r, p in zip(rows, prints):
            if r["doc_id"] is not None:
                least[root[p]] = min(r["doc_id"], least.get(root[p], r["doc_id"]))
        expected = sorted(((r["doc_id"] is None, r["doc_id"] or 0, p, least.get(root[p])) for r, p in zip(rows, prints)), key=str)
        got = gs.near_duplicates(docs).collect()
        found = [(r["doc_id"] is None, r["doc_id"] or 0, unsigned(r["fingerprint_bits"]), r["component_id"]) for r in got]
        assert sorted(found, key=str) == expected


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    kept = gs.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # the two equal rows are one group, null, empty and blank texts another
    groups = {r["group"] for r in gs.near_duplicates(odd_docs).collect()}
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 2, 5, 6, 7, 7] and sum(r["doc_id"] is None for r in rows) == 1
    assert gs.near_duplicates(no_docs).count() == 0 and gs.one_of_each(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(1399, 1000), (5000, 5000), (None, 7)]
    found = components(spark.createDataFrame(chain + star, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert len(found) == 701
