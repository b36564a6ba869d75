"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (words padded with a blank) are hashed to 2^16 features. The model is
trained with follow-the-regularised-leader (FTRL-proximal) steps under an elastic-net penalty, which
leaves most weights at exactly zero, and its logits are then divided by a temperature fitted on texts
that the training didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

BITS = 16
#: Most documents that a model is fitted on; a hash of the id picks them.
TRAIN_DOCS = 6000
#: FTRL: learning rate and its offset, elastic net, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter of the Basic Multilingual Plane, else a blank."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed features of the whole text and their counts; None if it has no letter."""
    if not text:
        return None
    if not _TABLE:
        _TABLE.append(_letters())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    beyond = cp > 0xFFFF
    c = _TABLE[0][np.where(beyond, 32, cp)]
    if beyond.any():
        c = c.copy()
        for i in np.flatnonzero(beyond):
            if chr(cp[i]).isalpha():
                c[i] = cp[i]
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    # Runs of blanks count as one.
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)
    if len(c) < 3:
        return None
    two = c[:-1] * _M[1] + c[1:] * _M[2]
    three = two[:-1] * _M[2] + c[2:] * _M[1]
    hashed = np.concatenate((c[c != 32] * _M[1], two * _M[0], three * _M[0])) >> np.uint64(64 - BITS)
    counts = np.bincount(hashed.astype(np.int64), minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[ids]
        return (v / max(1e-12, np.sqrt(v @ v))).astype(np.float32)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(ids, counts) @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if grams is None:
            return "und", 0.0
        p = _softmax(self.logits(*grams).astype(float) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(min(1.0, p[k]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[int, str, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (id, language, feature ids, counts); one in eight, by position, only sets the temperature."""
    examples = sorted(examples, key=lambda x: (x[0], x[1], x[2].tobytes()))
    languages = sorted({x[1] for x in examples})
    where = {x: i for i, x in enumerate(languages)}
    n, k = 1 << BITS, max(1, len(languages))
    df = np.zeros(n)
    for _, _, ids, _ in examples:
        df[ids] += 1
    model = Model(languages, np.log((1 + len(examples)) / (1 + df)).astype(np.float32) + 1, np.zeros((n, k), np.float32), np.zeros(k, np.float32))
    held, seen = examples[::8], [x for i, x in enumerate(examples) if i % 8]
    data = [(where[lang], ids, model.vector(ids, counts)) for _, lang, ids, counts in seen]
    # State of FTRL: z and the sum of squared gradients for every weight; the bias is feature n.
    z, q = np.zeros((n + 1, k)), np.zeros((n + 1, k))
    rng = np.random.default_rng(0)

    def solved(zi: np.ndarray, qi: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(qi)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            y, ids, v = data[i]
            rows = np.append(ids, n)
            x = np.append(v, 1.0)[:, None]
            w = solved(z[rows], q[rows])
            g = _softmax((x * w).sum(axis=0))
            g[y] -= 1
            g = x * g
            s = (np.sqrt(q[rows] + g * g) - np.sqrt(q[rows])) / ALPHA
            z[rows] += g - s * w
            q[rows] += g * g
    w = solved(z, q)
    model.weights, model.bias = w[:n].astype(np.float32), w[n].astype(np.float32)
    if held:
        logits, y = np.array([model.logits(ids, counts) for _, _, ids, counts in held], float), np.array([where[x[1]] for x in held])
        ts = np.exp(np.linspace(np.log(0.002), np.log(20), 185))
        # As with Platt's targets, a little mass lies on the other languages, lest few errors give no heat at all.
        goal = np.full((len(y), k), 1 / (len(y) + 2) / k)
        goal[np.arange(len(y)), y] += 1 - 1 / (len(y) + 2)
        loss = [-(goal * np.log(np.maximum(1e-300, _softmax(logits / t)))).sum(axis=1).mean() for t in ts]
        model.temperature = float(ts[int(np.argmin(loss))])
    return model


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows from all of the table, picked by a hash of the whole row; equal rows all or none."""
    n = df.count()
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(*df.columns, F.lit(8)), F.lit(1 << 20)) < int(limit / n * (1 << 20)))
    return df


def at_most(df: DataFrame, limit: int) -> list:
    """The rows, of which the driver gets ``limit`` at most: the first by a hash of the whole row."""
    return df.orderBy(F.xxhash64(*df.columns)).limit(limit).collect()


def fit(labelled: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Train on rows (doc_id, text, lang), about ``limit`` of them and never more than twice as many, whole texts.

    Ids may be null or repeat; a row that repeats counts as often as it is picked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, lang, ngrams(t)) for i, t, lang in zip(b["doc_id"], b["text"], b["lang"])]
            got = [(i, lang, g) for i, lang, g in got if g is not None]
            yield pd.DataFrame({"doc_id": [x[0] for x in got], "lang": [x[1] for x in got], "ids": [x[2][0].astype("<u2").tobytes() for x in got], "counts": [x[2][1].astype("<u4").tobytes() for x in got]})

    rows = bounded(labelled.where("text is not null and lang is not null").select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "text", "lang"), limit)
    feats = at_most(rows.mapInPandas(run, "doc_id long, lang string, ids binary, counts binary"), 2 * limit)
    return train([(r[0], r[1], np.frombuffer(r[2], "<u2"), np.frombuffer(r[3], "<u4")) for r in feats])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row.

    The score is the calibrated probability of the language. Null texts and those without any letter
    are ``und`` with score 0; a model without training rows says ``und`` to all. All rows stay; columns
    named as ours are replaced. Only the text is looked at, all of it.
    """
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) if m.languages else ("und", 0.0) for t in texts], columns=["lang_pred", "score"])

    found = unused(df, "found")
    return df.withColumn(found, predict(F.col(text))).select(*df.columns, f"{found}.*")
