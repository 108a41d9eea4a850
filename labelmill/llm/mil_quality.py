"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Every passage is encoded
(histograms of neighbouring character classes and of hashed byte trigrams, and
how concentrated they are, through a learned tanh layer), gated attention
weights the encoded passages, and a logistic unit scores their weighted mean:
only documents have labels, the weights of passages are learned from them.

The model is fitted in numpy on a bounded sample: at most ``max_docs`` labelled
documents, the first by a hash of their ids, and ``PASSAGES_OF_ONE`` evenly
spaced passages of each.  Every passage of every document is scored; features
are made for a bounded number of passages at a time.

Null and empty texts are one passage without characters and get its score.
With no labelled document every score is 0.5.  Labels that are neither 0 nor 1
are left out, an id with both counts as 1.  Equal rows give equal results, null
keys are kept, an empty table gives an empty table, clashing columns are
replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from labelmill.llm.common import prepare, text_column, with_text_column

PASSAGE = 512
PASSAGES_OF_ONE = 12
MAX_DOCS = 3000
TRIGRAM_BINS = 512
HIDDEN = 24
GATED = 12
#: Passages whose features are held at a time.
AT_ONCE = 1024
#: Characters that are a class of their own, besides letters by case, digits, blanks, line ends, other bytes.
OWN_CLASS = ".,;:!?'\"-_|#$%&*@^~=+/\\<>()[]{}"


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", *OWN_CLASS]
    for n, group in enumerate(groups, start=1):
        table[np.frombuffer(group.encode("ascii"), dtype=np.uint8)] = n
    table[128:] = len(groups) + 1
    return table


CLASS_OF = _class_table()
CLASSES = int(CLASS_OF.max()) + 1
FEATURES = CLASSES * CLASSES + TRIGRAM_BINS + 4


def features(data: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """(n, FEATURES) of passages; ``passage`` has each byte's passage, in ascending order."""
    out = np.zeros((n, FEATURES), dtype=np.float32)
    size = np.bincount(passage, minlength=n).astype(np.float32)
    scale = 1 / np.sqrt(np.maximum(size, 1))[:, None]
    kind = CLASS_OF[data]
    two = passage[1:] == passage[:-1]
    pair = (passage[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:])[two]
    counts = np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts) * scale
    wide = data.astype(np.int64)
    three = passage[2:] == passage[:-2]
    mixed = (wide[:-2] * 40503 + wide[1:-1] * 30103 + wide[2:] * 15485863) >> 4 & (TRIGRAM_BINS - 1)
    counts = np.bincount((passage[:-2] * TRIGRAM_BINS + mixed)[three], minlength=n * TRIGRAM_BINS).reshape(n, -1)
    at = CLASSES * CLASSES
    out[:, at : at + TRIGRAM_BINS] = np.sqrt(counts) * scale
    safe = np.maximum(size, 1)
    out[:, -4] = (counts > 0).sum(axis=1) / safe
    out[:, -3] = counts.max(axis=1, initial=0) / safe
    out[:, -2] = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1)) / safe
    out[:, -1] = size / PASSAGE
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class AttentionModel:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
        self.w = {
            "encode": normal(FEATURES, HIDDEN) * np.float32(0.3),
            "encode_bias": np.zeros(HIDDEN, dtype=np.float32),
            "content": normal(HIDDEN, GATED) * np.float32(0.2),
            "gate": normal(HIDDEN, GATED) * np.float32(0.2),
            "attend": normal(GATED) * np.float32(0.2),
            "out": normal(HIDDEN) * np.float32(0.2),
            "out_bias": np.zeros(1, dtype=np.float32),
        }

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["encode"] + self.w["encode_bias"])

    def pool(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of bags whose passages begin at ``starts``, and what the gradients need."""
        content, gate = np.tanh(h @ self.w["content"]), _sigmoid(h @ self.w["gate"])
        raw = np.exp(np.clip((content * gate) @ self.w["attend"], -60, 60).astype(np.float64))
        sizes = np.diff(np.append(starts, len(h)))
        share = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return _sigmoid(z @ self.w["out"] + self.w["out_bias"]), z, share, content, gate, sizes

    def fit(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 1800, batch: int = 32, rate: float = 0.004) -> None:
        """Cross-entropy by Adam; both labels weigh alike in the mean of a batch only as far as they occur."""
        rng = np.random.default_rng(3)
        stops = np.append(starts[1:], len(x))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        while step < steps:
            for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                step += 1
                rows = np.concatenate([np.arange(starts[i], stops[i]) for i in some])
                sizes = stops[some] - starts[some]
                own = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                for k, g in self._gradients(x[rows], own, labels[some]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        h = self.encode(x)
        score, z, share, content, gate, sizes = self.pool(h, starts)
        error = (score - labels) / len(labels)
        dz = np.repeat(error[:, None] * self.w["out"][None], sizes, axis=0)  # of each passage's bag
        dot = (dz * h).sum(axis=1)
        mean = np.repeat(np.add.reduceat(share * dot, starts), sizes)
        draw = (share * (dot - mean))[:, None]
        dcontent = draw * self.w["attend"] * gate * (1 - content**2)
        dgate = draw * self.w["attend"] * content * gate * (1 - gate)
        dh = share[:, None] * dz + dcontent @ self.w["content"].T + dgate @ self.w["gate"].T
        da = dh * (1 - h**2)
        return {
            "encode": x.T @ da.astype(np.float32),
            "encode_bias": da.sum(axis=0),
            "content": h.T @ dcontent,
            "gate": h.T @ dgate,
            "attend": ((content * gate) * draw).sum(axis=0),
            "out": z.T @ error,
            "out_bias": np.array([error.sum()]),
        }

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of whole texts; every text has a passage, if an empty one."""
        coded = [(t or "").encode("utf-8") for t in texts]
        if not coded:
            return []
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        passages = np.maximum(-(-sizes // PASSAGE), 1)
        firsts = np.concatenate([[0], np.cumsum(passages)])
        left = np.repeat(sizes, passages) - PASSAGE * (np.arange(firsts[-1]) - np.repeat(firsts[:-1], passages))
        lengths = np.minimum(left, PASSAGE)
        ends = np.cumsum(lengths)
        h = np.empty((firsts[-1], HIDDEN), dtype=np.float32)
        for lo in range(0, firsts[-1], AT_ONCE):
            hi = min(lo + AT_ONCE, firsts[-1])
            own = data[ends[lo] - lengths[lo] : ends[hi - 1]]
            h[lo:hi] = self.encode(features(own, np.repeat(np.arange(hi - lo), lengths[lo:hi]), hi - lo))
        return self.pool(h, firsts[:-1])[0].tolist()


def _sample_passages(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8")
    n = max(1, -(-len(data) // PASSAGE))
    chosen = range(n) if n <= PASSAGES_OF_ONE else np.linspace(0, n - 1, PASSAGES_OF_ONE).astype(int)
    return [data[i * PASSAGE : (i + 1) * PASSAGE] for i in chosen]


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS
) -> AttentionModel | None:
    """A model fitted on the documents that ``labels`` marks 0 or 1; None if there are none."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("_labelled"), F.col(label).cast("int").alias("_label"))
    known = known.filter("_labelled is not null and _label in (0, 1)").groupBy("_labelled").agg(F.max("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_docs)

    @pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(_sample_passages)

    # max_docs rows at most are broadcast; passages are cut before they meet; equal rows are one document of the
    # sample, and where many texts share an id those with the smallest hashes are taken
    found = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_at"))
    found = found.join(F.broadcast(known), F.col("_doc") == F.col("_labelled"))
    found = found.select("_doc", "_label", cut(F.col("_text")).alias("_cut"), "_at").dropDuplicates(["_doc", "_at"])
    rows = [(r[0], r[1], [bytes(p) for p in r[2]]) for r in found.orderBy("_at", "_doc").limit(2 * max_docs).collect()]
    if not rows:
        return None
    rows.sort()
    passages = [p for r in rows for p in r[2]]
    lengths = np.fromiter(map(len, passages), dtype=np.int64, count=len(passages))
    x = np.concatenate(
        [
            features(np.frombuffer(b"".join(passages[lo : lo + AT_ONCE]), dtype=np.uint8), np.repeat(np.arange(len(some)), some), len(some))
            for lo in range(0, len(passages), AT_ONCE)
            for some in [lengths[lo : lo + AT_ONCE]]
        ]
    )
    starts = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])[:-1]])
    model = AttentionModel()
    model.fit(x, starts, np.array([r[1] for r in rows], dtype=np.float64))
    return model


def with_quality(docs: DataFrame, model: AttentionModel | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is 0.5 or more) of every whole text, named with ``prefix``."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def score(texts: list[str | None], known: AttentionModel | None) -> dict[str, list]:
        scores = []
        for block in _blocks(texts):
            scores += known.scores(block) if known else [0.5] * len(block)
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    column = text_column("score double, predicted int", score, lambda: held.value)
    return with_text_column(docs, column, text, ["score", "predicted"], prefix)


def _blocks(texts: list[str | None], most: int = 1 << 20) -> list[list[str | None]]:
    blocks, size = [[]], 0
    for t in texts:
        if blocks[-1] and size + len(t or "") > most:
            blocks.append([])
            size = 0
        blocks[-1].append(t)
        size += len(t or "")
    return blocks
