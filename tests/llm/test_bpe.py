import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from labelmill.llm import heap_bpe, numpy_bpe
from labelmill.llm.queries import op6_numpy_bpe, op8_token_counts, tokenizer


def library(name):
    return Tokenizer.from_file(tokenizer(name))


def expected_codes(texts):
    lib = library("word_bpe_49k.json")
    for text in texts:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        yield len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_codes_of_odd_texts_are_the_librarys(odd_docs):
    rows = numpy_bpe.with_encoding(odd_docs, tokenizer("word_bpe_49k.json")).collect()
    assert len(rows) == 10
    got = [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows]
    assert got == list(expected_codes(r["text"] for r in rows))


def test_codes_of_documents_are_the_librarys(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_numpy_bpe(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == dict(zip(docs, expected_codes(docs.values())))


def test_counts_of_odd_texts_are_the_librarys(odd_docs):
    lib = library("byte_bpe_50k.json")
    rows = heap_bpe.with_token_counts(odd_docs, tokenizer("byte_bpe_50k.json")).collect()
    assert len(rows) == 10
    for r in rows:
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 512)


def test_counts_of_documents_are_the_librarys(spark, sf_dir):
    lib = library("byte_bpe_50k.json")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op8_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}


def test_empty_tables(no_docs):
    assert numpy_bpe.with_encoding(no_docs, tokenizer("word_bpe_49k.json")).count() == 0
    assert heap_bpe.with_token_counts(no_docs, tokenizer("byte_bpe_50k.json")).count() == 0


def test_leftmost_only_where_merging_all_at_once_is_not_safe():
    vocabulary = numpy_bpe.Vocabulary(open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    words = [b"aaaaaaa", b"banana", b"mississippi", b"x"]
    assert vocabulary.ordered
    at_once = [w.tolist() for w in vocabulary.merge(words)]
    vocabulary.ordered = False
    assert [w.tolist() for w in vocabulary.merge(words)] == at_once


def test_ids_decode_to_texts(spark):
    docs = spark.createDataFrame([(1, "Hello wide world"), (2, None)], "doc_id long, text string")
    path = tokenizer("word_bpe_49k.json")
    rows = numpy_bpe.decode_ids(numpy_bpe.with_encoding(docs, path, ids=True), path).orderBy("doc_id").collect()
    assert [r["decoded_text"] for r in rows] == ["hello</w> wide</w> world</w>", ""]


@pytest.mark.parametrize("word", ["a", "ab", "!!!!!!!!", "zzzzzzzzzzzz", "thththth"])
def test_heap_counts_equal_plain_merging(word):
    counter = heap_bpe.TokenCounter(open(tokenizer("byte_bpe_50k.json"), encoding="utf-8").read())
    symbols = [counter.symbols[b] for b in word.encode()]
    while True:
        known = [(counter.ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in counter.ranks]
        if not known:
            break
        _, i = min(known)
        symbols[i : i + 2] = [counter.ranks[symbols[i], symbols[i + 1]][1]]
    assert counter.count_word(word) == len(symbols)
