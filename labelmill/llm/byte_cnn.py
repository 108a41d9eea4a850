"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of fixed length.  Filters of several
widths over byte embeddings, the maximum of each filter over the window, and a
softmax give a window's language probabilities; a text's are the mean over all
its windows, weighted by their bytes.  The network is fitted on a bounded
sample of every language that occurs: ``per_lang`` documents of each, or an
equal share of ``SAMPLE`` documents where there are very many languages but
``FLOOR`` at least, those with the smallest hashes of id and text, and
``WINDOWS_OF_ONE`` evenly spaced windows of each.

Null texts and texts without a letter are 'und' with score 0.  With nothing to
learn from, every text is 'und'.  Equal rows give equal results, null keys are
kept, an empty table gives an empty table, clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from labelmill.llm.common import keep, prepare, text_column, with_text_column

WINDOW = 256
WIDTHS = (2, 3, 4)
WIDEST = max(WIDTHS)
PLACES = WINDOW - WIDEST + 1
EMBEDDED = 8
FILTERS = 16
PER_LANG = 500
#: Documents of all languages together, and the least of one.
SAMPLE = 100_000
FLOOR = 20
#: Languages whose shares are broadcast; more are joined by Spark's choice.
BROADCAST_LANGUAGES = 100_000
#: Training steps, and those of each language where there are many.
STEPS = 700
STEPS_OF_ONE = 20
WINDOWS_OF_ONE = 4
#: Windows that are evaluated at a time, and convolved at a time (to stay in a core's cache).
AT_ONCE = 512
CONVOLVED = 16
LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """One bank of filters of the largest width; those of smaller widths have zeros in the last places."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
        width = np.repeat(WIDTHS, FILTERS)
        self.used = (np.arange(WIDEST)[:, None] < width).repeat(EMBEDDED, axis=0).astype(np.float32)
        self.w = {
            "embed": normal(256, EMBEDDED) * np.float32(0.5),
            "filters": normal(WIDEST * EMBEDDED, len(width)) * self.used / np.sqrt(width * EMBEDDED).astype(np.float32),
            "bias": np.zeros(len(width), dtype=np.float32),
            "out": normal(len(width), len(languages)) * np.float32(0.1),
            "out_bias": np.zeros(len(languages), dtype=np.float32),
        }

    def _convolved(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, filters)."""
        embedded = self.w["embed"].take(windows, axis=0)
        n, item = len(windows), embedded.itemsize
        patches = np.lib.stride_tricks.as_strided(
            embedded, (n, PLACES, WIDEST * EMBEDDED), (embedded.strides[0], EMBEDDED * item, item)
        )
        return patches.reshape(n * PLACES, -1).dot(self.w["filters"]).reshape(n, PLACES, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best = np.concatenate(
            [self._convolved(windows[lo : lo + CONVOLVED]).max(axis=1) for lo in range(0, len(windows), CONVOLVED)]
        )
        return _softmax(np.maximum(best + self.w["bias"], 0) @ self.w["out"] + self.w["out_bias"])

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.01) -> None:
        """Cross-entropy by Adam; classes are weighted to count alike."""
        rng = np.random.default_rng(11)
        counts = np.bincount(labels, minlength=len(self.languages))
        weight = (len(labels) / np.maximum(counts, 1) / len(self.languages)).astype(np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        while step < steps:
            for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                step += 1
                for k, g in self._gradients(windows[some], labels[some], weight).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """A maximum passes its gradient to the place that it was taken from."""
        x = self._convolved(windows)
        places = x.argmax(axis=1)
        best = np.take_along_axis(x, places[:, None], axis=1)[:, 0] + self.w["bias"]
        active = np.maximum(best, 0)
        p = _softmax(active @ self.w["out"] + self.w["out_bias"])
        p[np.arange(len(labels)), labels] -= 1
        p *= (weight[labels] / len(labels))[:, None]
        back = (p @ self.w["out"].T) * (best > 0)
        rows, embed = np.arange(len(windows))[:, None], np.zeros_like(self.w["embed"])
        bank, grad = self.w["filters"].reshape(WIDEST, EMBEDDED, -1), []
        for j in range(WIDEST):
            chosen = windows[rows, places + j]  # (windows, filters): the byte that each maximum met
            grad.append(np.einsum("bfe,bf->ef", self.w["embed"][chosen], back))
            np.add.at(embed, chosen.ravel(), (back[..., None] * bank[j].T[None]).reshape(-1, EMBEDDED))
        return {
            "out": active.T @ p,
            "out_bias": p.sum(axis=0),
            "bias": back.sum(axis=0),
            "filters": np.concatenate(grad) * self.used,
            "embed": embed,
        }

    def classify(self, texts: list[str | None]) -> dict[str, list]:
        """Languages and mean probabilities of whole texts, over bounded numbers of windows at a time."""
        coded = [t.encode("utf-8") if t and LETTER.search(t) else b"" for t in texts]
        total, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for owners, sizes, windows in _in_turn(coded):
            p = self.probabilities(windows) * sizes[:, None]
            np.add.at(sums, owners, p)
            np.add.at(total, owners, sizes)
        best = sums.argmax(axis=1) if len(texts) else []
        names = [self.languages[b] if n else "und" for b, n in zip(best, total)]
        return {"lang_pred": names, "score": [float(sums[i, b] / n) if n else 0.0 for i, (b, n) in enumerate(zip(best, total))]}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _in_turn(coded: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, bytes, windows) of at most AT_ONCE windows."""
    owners, sizes, parts, held = [], [], [], 0
    for i, data in enumerate(coded):
        for lo in range(0, len(data), AT_ONCE * WINDOW):
            own = _windows(data[lo : lo + AT_ONCE * WINDOW])
            left = len(data) - lo
            if held and held + len(own) > AT_ONCE:
                yield np.concatenate(owners), np.concatenate(sizes), np.concatenate(parts)
                owners, sizes, parts, held = [], [], [], 0
            owners.append(np.full(len(own), i))
            sizes.append(np.minimum(left - WINDOW * np.arange(len(own)), WINDOW).astype(np.float64))
            parts.append(own)
            held += len(own)
    if held:
        yield np.concatenate(owners), np.concatenate(sizes), np.concatenate(parts)


def _sample_windows(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8")
    n = -(-len(data) // WINDOW)
    chosen = range(n) if n <= WINDOWS_OF_ONE else np.linspace(0, n - 1, WINDOWS_OF_ONE).astype(int)
    return [data[i * WINDOW : (i + 1) * WINDOW] for i in chosen]


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG
) -> ByteNet | None:
    """A network fitted on rows of ``docs`` with text and language; None if there are none."""
    prepare(docs.sparkSession)
    place = F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(F.lit((1 << 52) - 1))
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(lang).alias("lang"), place.alias("place"), F.col(text).alias("text"))
    counts = keep(known.groupBy("lang").count(), "language-counts")
    many = counts.count()
    if not many:
        return None
    most = max(FLOOR, min(per_lang, SAMPLE // many))
    # twice the wanted documents in the mean, of which the first are taken; all of a language that has few
    share = F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("count"))
    shares = counts.select(F.col("lang").alias("of"), share.alias("share"))
    shares = F.broadcast(shares) if many <= BROADCAST_LANGUAGES else shares
    chosen = known.join(shares, F.col("lang") == F.col("of")).filter(F.col("place") / F.lit(float(1 << 52)) < F.col("share"))

    @pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(_sample_windows)

    # windows are cut before they meet; equal rows have equal places and are one document of the sample
    parts = chosen.select("lang", "place", cut("text").alias("windows")).dropDuplicates(["lang", "place"])
    ranked = parts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("nth") <= most)
    rows = sorted((r["lang"], bytes(r["window"])) for r in ranked.select("lang", F.explode("windows").alias("window")).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    net = ByteNet(languages)
    labels = np.searchsorted(np.array(languages, dtype=object), np.array([r[0] for r in rows], dtype=object))
    net.fit(np.concatenate([_windows(r[1]) for r in rows]), labels, max(STEPS, STEPS_OF_ONE * len(languages)))
    return net


def with_language(docs: DataFrame, net: ByteNet | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score of every whole text, named with ``prefix``."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(net)

    def classify(texts: list[str | None], known: ByteNet | None) -> dict[str, list]:
        return known.classify(texts) if known else {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}

    column = text_column("lang_pred string, score double", classify, lambda: held.value)
    return with_text_column(docs, column, text, ["lang_pred", "score"], prefix)
