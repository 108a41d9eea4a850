import numpy as np
import pytest

from labelmill.llm import byte_cnn, mil_quality
from labelmill.llm.queries import op1_quality, op10_byte_cnn

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op1_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 100
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.95
    good = [r["score"] for r in rows if labels[r["doc_id"]]]
    bad = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in op10_byte_cnn(spark, SF).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) > 200
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.95


def test_a_document_is_scored_from_all_its_passages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = mil_quality.fit(docs, labels)
    text = docs.filter("lang = 'en'").join(labels.filter("quality = 1"), "doc_id").first()["text"]
    long = (text + "\n") * (3_000_000 // len(text))
    assert model.scores([long + "$$$### %%% " * 100_000])[0] != model.scores([long])[0]
    # texts of a block do not influence each other
    apart = [model.scores([t])[0] for t in (text, "", long, None)]
    assert np.allclose(model.scores([text, "", long, None]), apart)
    # the pooled vector is the attention-weighted mean of the encoded passages
    data = text.encode()
    parts = [data[i : i + mil_quality.PASSAGE] for i in range(0, len(data), mil_quality.PASSAGE)]
    h = np.concatenate([model.encode(mil_quality.features(np.frombuffer(p, np.uint8), np.zeros(len(p), int), 1)) for p in parts])
    raw = np.exp((np.tanh(h @ model.w["content"]) / (1 + np.exp(-(h @ model.w["gate"])))) @ model.w["attend"])
    z = (raw[:, None] * h).sum(axis=0) / raw.sum()
    assert np.isclose(model.scores([text])[0], 1 / (1 + np.exp(-(z @ model.w["out"] + model.w["out_bias"][0]))), atol=1e-5)


def test_attention_gradients_are_right():
    rng = np.random.default_rng(0)
    model = mil_quality.AttentionModel()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, starts, labels = rng.random((7, mil_quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.pool(model.encode(x), starts)[0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    gradients = model._gradients(x, starts, labels)
    for name, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        kept, step = w[at], 1e-5
        w[at] = kept + step
        above = loss()
        w[at] = kept - step
        assert np.isclose((above - loss()) / (2 * step), gradients[name][at], rtol=1e-3, atol=1e-7), name
        w[at] = kept


def test_convolution_gradients_are_right():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteNet(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows, labels = rng.integers(0, 256, (5, byte_cnn.WINDOW), dtype=np.uint8), np.array([0, 1, 1, 0, 1])
    weight = np.array([0.7, 1.4])
    loss = lambda: -np.mean(weight[labels] * np.log(net.probabilities(windows)[np.arange(5), labels]))
    gradients = net._gradients(windows, labels, weight)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name != "embed" else (int(windows[0, 3]), 2)
        if name == "filters":
            at = (0, at[1])
        kept, step = w[at], 1e-5
        w[at] = kept + step
        above = loss()
        w[at] = kept - step
        assert np.isclose((above - loss()) / (2 * step), gradients[name][at], rtol=1e-2, atol=1e-6), name
        w[at] = kept


def test_convolution_equals_a_plain_one():
    net = byte_cnn.ByteNet(["a", "b"])
    window = np.frombuffer(bytes(range(256)), np.uint8)[None]
    plain = np.array(
        [(net.w["embed"][window[0, i : i + byte_cnn.WIDEST]].ravel() @ net.w["filters"]) for i in range(byte_cnn.PLACES)]
    )
    assert np.allclose(net._convolved(window)[0], plain, atol=1e-5)


def test_odd_texts(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.fit(docs)
    rows = byte_cnn.with_language(odd_docs, net).collect()
    assert len(rows) == 10
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] > 0) == letters
    model = mil_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = mil_quality.with_quality(odd_docs, model).collect()
    assert len(scored) == 10 and all(0 <= r["score"] <= 1 for r in scored)
    assert scored[0]["score"] == scored[1]["score"]
    empty = {r["score"] for r in scored if not r["text"]}
    assert len(empty) == 1
    assert mil_quality.with_quality(no_docs, model).count() == 0 and byte_cnn.with_language(no_docs, net).count() == 0


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 7)], "doc_id long, quality int")
    assert mil_quality.fit(odd_docs, labels) is None and byte_cnn.fit(no_docs) is None
    assert {r["score"] for r in mil_quality.with_quality(odd_docs, None).collect()} == {0.5}
    assert {r["lang_pred"] for r in byte_cnn.with_language(odd_docs, None).collect()} == {"und"}


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 256 * 1100 + 3])
def test_windows_cover_whole_texts(size):
    data = bytes(np.random.default_rng(0).integers(1, 256, size, dtype=np.uint8))
    got = b"".join(w[: int(n)].tobytes() for _, ns, ws in byte_cnn._in_turn([b"x", data]) for n, w in zip(ns, ws))
    assert got == b"x" + data


def test_every_language_is_learned(spark):
    """A hundred languages, some rows without an id, one row a third of the table."""
    rng, rows = np.random.default_rng(3), []
    letters = [chr(c) for c in range(0x61, 0x7B)]
    for lang in range(100):
        own = rng.choice(letters, 3, replace=False)
        for n in range(14):
            text = " ".join("".join(rng.choice(own, rng.integers(2, 6))) for _ in range(60))
            rows.append((None if n % 3 == 0 else 100 * lang + n, text, f"l{lang:02}", n >= 12))
    again = [rows[1]] * 700
    docs = spark.createDataFrame(rows + again, "doc_id long, text string, lang string, held_out boolean").repartition(5)
    net = byte_cnn.fit(docs.filter("NOT held_out"))
    assert net.languages == sorted({r[2] for r in rows})
    held = [r for r in rows if r[3]]
    found = net.classify([r[1] for r in held])["lang_pred"]
    assert np.mean([f == r[2] for f, r in zip(found, held)]) > 0.8
