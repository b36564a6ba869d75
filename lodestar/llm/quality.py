"""Quality scores by naive Bayes support vectors (NB-SVM).

N-gram indicators of a text (words, all pairs of words, shapes, rounded shares of repetition and marks) are
scaled by the log ratio of how often documents of either class have them; on these a linear model with
hinge loss is fitted by dual coordinate descent, and its margin is turned into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 21
#: Most labelled documents that a model is fitted on; a hash of the id picks them.
TRAIN_DOCS = 8000
#: Penalty of the hinge loss, passes of coordinate descent, smoothing of the counts.
COST, EPOCHS, SMOOTH = 0.1, 12, 1.0

#: Marks that are looked at around a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """Word -> hash of the word in lower case, above 32 bits the hash of its shape.

    A shape is the case of the word, whether it is all letters, and its first and last marks.
    """

    def __missing__(self, word: str) -> int:
        core = word.strip(_MARKS)
        case = "a" if core.islower() else "A" if core.isupper() else "T" if core.istitle() else "-"
        shape = f"{case}{core.isalpha():d}{core.isdigit():d}{word[: word.find(core)][:3]} {word[word.rfind(core) + len(core) :][:3]}" if core else word[:6]
        low = word.lower()
        v = zlib.crc32(shape.encode("utf-8", "surrogatepass"), 1) << 32 | _h(low)
        if len(self) < 300_000 and len(word) <= 32:
            self[word] = v
        return v


_words = _Words()
_CLASS: list[np.ndarray] = []


def _shares(text: str) -> tuple[float, float]:
    """Of letters and of capitals among all characters."""
    if not _CLASS:
        _CLASS.append(np.array([chr(c).isalpha() + 2 * chr(c).isupper() for c in range(0x10000)], dtype=np.uint8))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.bincount(_CLASS[0][np.minimum(cp, 0xFFFF)], minlength=4)
    return (n[1] + n[3]) / len(cp), (n[2] + n[3]) / len(cp)


def _step(x: float, k: int = 20) -> int:
    return int(round(min(1.0, max(0.0, x)) * k))


def features(text: str | None) -> np.ndarray:
    """Hashed indicators of the whole text, sorted; a text without words has only the indicator of that."""
    words = (text or "").split()
    if not words:
        return np.array([_h("empty") >> (32 - BITS)], dtype=np.int64)
    n = len(words)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    low = w & np.uint64(0xFFFFFFFF)
    ids, count = np.unique(low, return_counts=True)
    shapes, in_shape = np.unique(w >> np.uint64(32), return_counts=True)
    pairs, in_pair = np.unique(low[:-1] * np.uint64(0x9E3779B97F4A7C15) + low[1:] * np.uint64(0xC2B2AE3D27D4EB4F), return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    letters, caps = _shares(text)
    out = ["n%d" % int(np.log2(n))]
    for name, share in (
        ("distinct", len(ids) / n), ("top", count.max() / n), ("pairs", len(pairs) / max(1, n - 1)), ("toppair", in_pair.max(initial=0) / max(1, n - 1)),
        ("letters", letters), ("caps", caps), ("lines", len(set(lines)) / max(1, len(lines))), ("width", min(1.0, n / max(1, len(lines)) / 100)),
    ):
        k = _step(share)
        out += [f"{name}={k}", f"{name}~{k // 2}", *(f"{name}<{j}" for j in range(k + 1, 21, 3))]
    tenths = np.round(in_shape / n * 10).astype(np.uint64)
    mixed = np.concatenate((ids, shapes, shapes * np.uint64(31) + tenths + np.uint64(7), pairs, np.fromiter(map(_h, out), dtype=np.uint64, count=len(out))))
    return np.unique((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        ids = features(text)
        z = self.slope * (float(self.weights[ids].sum()) / np.sqrt(len(ids)) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train(examples: list[tuple[int, int, np.ndarray]]) -> Model:
    """Fit on (id, label, feature ids). Every fifth example, by position, only sets the probabilities."""
    examples = sorted(examples, key=lambda x: (x[0], x[1], x[2].tobytes()))
    if len({x[1] for x in examples}) < 2:
        share = examples[0][1] if examples else 0.5
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 4.0 * (share - 0.5) * 2)
    held, seen = examples[::5], [x for i, x in enumerate(examples) if i % 5]
    counts = np.full((2, 1 << BITS), SMOOTH)
    for _, y, ids in seen:
        counts[y, ids] += 1
    total = [sum(x[1] == k for x in seen) + 2 * SMOOTH for k in (0, 1)]
    ratio = np.log(counts[1] / total[1]) - np.log(counts[0] / total[0])
    # Dual coordinate descent for the L1 hinge loss; the bias is a feature of value 1, classes weigh alike.
    w, b = np.zeros(1 << BITS), 0.0
    y = np.array([1.0 if x[1] else -1.0 for x in seen])
    xs = [(ids, ratio[ids] / np.sqrt(len(ids))) for _, _, ids in seen]
    diag = np.array([v @ v + 1.0 for _, v in xs])
    cost = COST * len(seen) / 2 / np.maximum(1, np.array([(y > 0).sum() if t > 0 else (y < 0).sum() for t in y]))
    alpha = np.zeros(len(seen))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(seen)):
            ids, v = xs[i]
            g = y[i] * (w[ids] @ v + b) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), cost[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[ids] += d * v
                b += d
                alpha[i] = new
    weights = (w * ratio).astype(np.float32)
    m = np.array([weights[ids].sum() / np.sqrt(len(ids)) + b for _, _, ids in held])
    t = np.array([x[1] for x in held], float)
    # Platt's fit of a slope and an offset by Newton steps, with his smoothed targets.
    pos, neg = t.sum(), len(t) - t.sum()
    goal = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -35, 35)))
        r, s = p - goal, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[s @ (m * m) + 1e-3, s @ m], [s @ m, s.sum() + 1e-6]])
        step = np.linalg.solve(h, [r @ m + 1e-3 * a, r.sum()])
        size = max(1.0, np.abs(step).max())
        a, c = a - step[0] / size, c - step[1] / size
    return Model(weights, float(b), float(max(a, 1e-3)), float(c))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Train on the texts of docs (doc_id, text) that labels (doc_id, quality 0 or 1) mark, whole texts.

    A hash picks about ``limit`` labels, each id with each label once, and only they are broadcast. Ids may
    repeat among docs, but no more than twice ``limit`` of their documents are learned from.
    A document with contrary labels counts with each.
    """
    from .lang_id import at_most, bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "ids": [features(t).astype("<u4").tobytes() for t in b["text"]]})

    marks = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded(marks, limit)), "doc_id")
    feats = at_most(rows.select("doc_id", "text", "quality").mapInPandas(run, "doc_id long, quality int, ids binary"), 2 * limit)
    return train([(r[0], r[1], np.frombuffer(r[2], "<u4").astype(np.int64)) for r in feats])


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (probability of quality 1) and predicted (1 from ``threshold`` on) to every row.

    Null texts and texts without words get the score of an empty text. All rows stay, repeated ones
    too; columns named as ours are replaced. Only the text is looked at, all of it.
    """
    df = df.drop("score", "predicted")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return df.withColumn("score", probability(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
