import base64
import hashlib

import numpy as np
import pytest
import tiktoken

from labelmill.llm import training_order as to
from labelmill.llm.queries import tokenizer
from labelmill.session import scratch_dir


@pytest.fixture(scope="module")
def encode():
    lines = open(tokenizer("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=to.WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def plain_sequences(rows, encode, length):
    for i, text in rows:
        ids = encode(text or "")
        for s in range(max(1, -(-len(ids) // length))):
            part = np.array(ids[s * length : (s + 1) * length], dtype="<u2")
            yield (i, s, len(part), hashlib.sha256(part.tobytes()).hexdigest())


@pytest.mark.parametrize("domain", [1, 2, 3, 100, 1023, 4097])
def test_every_number_has_a_place(domain):
    order = to.Permutation("key", domain)(np.arange(domain))
    assert sorted(order.tolist()) == list(range(domain))
    if domain > 100:
        assert order.tolist() != to.Permutation("other", domain)(np.arange(domain)).tolist()
        assert abs(np.corrcoef(np.arange(domain), order.astype(float))[0, 1]) < 0.15


@pytest.mark.parametrize(("length", "shard_bytes"), [(256, to.SHARD_BYTES), (16, 4000)])
def test_shards_give_back_all_sequences(spark, odd_docs, sf_dir, encode, monkeypatch, length, shard_bytes):
    monkeypatch.setattr(to, "SHARD_BYTES", shard_bytes)
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        path = scratch_dir(spark, "test-shards")
        to.write_shards(docs, tokenizer("byte_bpe_50k.tiktoken"), path, "k", length)
        rows = to.read_shards(spark, path, length).collect()
        got = [(r["doc_id"], r["seq_no"], r["n_tokens"], r["ids_sha256"]) for r in rows]
        plain = plain_sequences([(r["doc_id"], r["text"]) for r in docs.collect()], encode, length)
        assert sorted(got, key=str) == sorted(plain, key=str)
        assert sorted(r["position"] for r in rows) == list(range(len(rows)))


def test_order_depends_on_the_key_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    orders = []
    for some, key in ((docs, "k"), (docs.repartition(7), "k"), (docs, "other")):
        path = scratch_dir(spark, "test-shards")
        to.write_shards(some, tokenizer("byte_bpe_50k.tiktoken"), path, key)
        orders.append([(r["doc_id"], r["seq_no"]) for r in to.read_shards(spark, path).orderBy("position").collect()])
    assert orders[0] == orders[1] != orders[2]
    assert orders[0] != sorted(orders[0])


def test_reading_resumes_at_any_position(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(to, "SHARD_BYTES", 50_000)
    path = scratch_dir(spark, "test-shards")
    shards = to.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.tiktoken"), path)
    assert shards > 5
    whole = {r["position"]: tuple(r) for r in to.read_shards(spark, path).collect()}
    for start in (0, 1, len(whole) // 2, len(whole) - 1, len(whole)):
        rest = {r["position"]: tuple(r) for r in to.read_shards(spark, path, start=start).collect()}
        assert rest == {p: r for p, r in whole.items() if p >= start}


def test_no_documents(spark, no_docs):
    path = scratch_dir(spark, "test-shards")
    to.write_shards(no_docs, tokenizer("byte_bpe_50k.tiktoken"), path)
    assert to.read_shards(spark, path).count() == 0


@pytest.mark.parametrize("kind", ["no ids", "one id", "equal rows", "empty texts", "hashed ids"])
def test_shards_are_even_whatever_the_ids(spark, encode, monkeypatch, kind):
    monkeypatch.setattr(to, "SHARD_BYTES", 40_000)
    text = lambda i: "" if kind == "empty texts" else "the same text" if kind == "equal rows" and i % 3 == 0 else f"text number {i} " * 5
    own = {"no ids": lambda i: None if i % 3 == 0 else i, "one id": lambda i: 7 if i % 3 == 0 else i, "equal rows": lambda i: 7 if i % 3 == 0 else i}
    hashed = lambda i: (i * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
    rows = [(own.get(kind, hashed)(i), text(i)) for i in range(3000)]
    path = scratch_dir(spark, "test-shards")
    shards = to.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer("byte_bpe_50k.tiktoken"), path)
    assert shards == max(3000 * to.stride(), sum(len(t) for _, t in rows)) // 40_000 > 30
    found = to.read_shards(spark, path).collect()
    assert sorted(((r["doc_id"], r["seq_no"], r["n_tokens"], r["ids_sha256"]) for r in found), key=str) == sorted(plain_sequences(rows, encode, to.LENGTH), key=str)
    assert sorted(r["position"] for r in found) == list(range(len(found)))
    sizes = np.bincount([r["shard"] for r in found], minlength=shards)
    assert sizes.max() < 3 * sizes.mean()
