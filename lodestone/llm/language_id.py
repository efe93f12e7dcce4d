"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 2- to 4-grams. Embeddings and the
softmax are trained together by stochastic gradient descent in numpy on a bounded sample
(``per_language`` rows of each label for training and as many for calibration). On the
calibration rows a temperature is fitted, so that scores are probabilities. A text is
rejected where the label is more likely wrong than right (``LEAST``), and below the least
score that keeps the error among accepted calibration texts within ``target_error``: only where
the model itself is worse than that, and measured on whole texts, not on their snippets.
:func:`risk` reports error against coverage on any labelled rows.

Since the softmax is linear, a bucket's embedding times the softmax's weights is one row
of class scores; prediction over whole texts needs this table only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import apart, small_batches

BITS, DIM, ORDERS = 14, 16, (2, 3, 4)
#: Bound of the training sample: rows per label, for training and for calibration each, and rows of all labels
#: (beyond ``ROWS / PER_LANGUAGE`` labels each has fewer, at least one). A row takes at most 98 KB of the driver's
#: memory, whatever the text's length, since there are ``2 ** BITS`` buckets.
PER_LANGUAGE, ROWS = 400, 6400
#: Most labels whose counts are broadcast.
BROADCAST_LABELS = 100_000
#: Calibrated probability of the label below which a text is rejected in any case.
LEAST = 0.5
UNDETERMINED = "und"
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
_PLAIN = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    # the pattern takes numbers such as ² and Ⅳ as well, which aren't letters
    return any(c.isalpha() for m in _LETTER.finditer(text) for c in m[0])


def buckets(text: str) -> np.ndarray:
    """The buckets of all subwords of a text, one entry for each occurrence."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)
    out = []
    for n in ORDERS:
        if len(a) < n:
            continue
        h = np.zeros(len(a) - n + 1, np.uint32)
        for k in range(n):
            h = (h ^ a[k : k + len(h)]) * _MULT[k]
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    labels: list[str]
    #: class scores of each bucket, and the bias
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, ids: np.ndarray) -> np.ndarray:
        logits = np.bincount(ids, minlength=len(self.table)) @ self.table / max(1, len(ids)) + self.bias
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Label and calibrated probability; ``und`` and 0 for null texts and texts without a letter."""
        if text is None or not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.scores(buckets(text))
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _logits(x: np.ndarray, model: Model) -> np.ndarray:
    return x @ model.table + model.bias


def fit(rows: list[tuple], epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 7) -> Model:
    """Train on rows that begin with (label, buckets, counts) by stochastic gradient descent with a falling rate."""
    labels = sorted({r[0] for r in rows})
    rng, k = np.random.default_rng(seed), 1 << BITS
    emb = rng.normal(0, 1 / DIM, (k, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    at = {c: i for i, c in enumerate(labels)}
    y = np.array([at[r[0]] for r in rows])
    steps, step = epochs * max(1, -(-len(rows) // batch)), 0
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(len(rows)), max(1, -(-len(rows) // batch))):
            lr = rate * (1 - step / steps)
            step += 1
            x = np.zeros((len(own), k), np.float32)
            for j, i in enumerate(own):
                x[j, rows[i][1]] = rows[i][2] / max(1, rows[i][2].sum())
            mean = x @ emb
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            grad_w, grad_mean = mean.T @ p, p @ w.T
            # a bucket's share of a mean is small, so its rate is raised by the dimension of the text
            emb -= lr * 200 * (x.T @ grad_mean)
            w -= lr * 10 * grad_w
            bias -= lr * p.sum(0)
    return Model(labels, (emb.astype(np.float64) @ w), bias.astype(np.float64))


def calibrate(model: Model, rows: list[tuple], target_error: float = 0.05, least: float = LEAST) -> Model:
    """Fit temperature and rejection threshold on (label, buckets, counts, whole) rows that the training has not seen."""
    model.threshold = least
    rows = [r for r in rows if r[0] in model.labels and r[2].sum()]
    if not rows:
        return model
    z = np.array([model.table[r[1]].T @ (r[2] / r[2].sum()) + model.bias for r in rows])
    y = np.array([model.labels.index(r[0]) for r in rows])

    def nll(t: float) -> float:
        s = z / t
        m = s.max(1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.05, 20, 121).tolist(), key=nll)
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    p /= p.sum(1, keepdims=True)
    whole = np.array([r[3] for r in rows], bool)
    score, right = p.max(1)[whole], (p.argmax(1) == y)[whole]
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(errors <= target_error)
    wanted = 0.0 if len(good) and good[-1] == len(order) - 1 else float(score[order[good[-1]]]) if len(good) else 1.0
    model.threshold = max(least, wanted)
    return model


def _sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, part: str, per_language: int) -> list[tuple]:
    """At most ``per_language`` rows of each label, and ``ROWS`` in all, in a hash order of their ids, as bucket counts."""
    few = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).alias("y"), F.xxhash64(F.lit(part), F.col(id_col)).alias("o"))
    # a bound on the hash order, from counts, leaves about four times the rows wanted of each label; the window sees no more
    counts = few.groupBy("y").agg(F.count("*").alias("n"))
    labels = counts.count()
    per_language = max(1, min(per_language, ROWS // max(1, labels)))
    # so that no row beyond the bound is shuffled to its label's window
    counts = F.broadcast(counts) if labels <= BROADCAST_LABELS else counts
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    few = few.join(counts, "y").where(F.col("o").cast("double") <= F.lit(-9.223372036854775e18) + share * F.lit(1.8446744073709552e19))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("o", "i"))).where(F.col("r") <= per_language)
    ids = few.select(F.col("i").alias("__i"))
    texts = docs.join(F.broadcast(ids), docs[id_col].eqNullSafe(ids["__i"]), "left_semi").select(F.col(label_col).alias("y"), F.col(text_col).alias("t"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, t in zip(b["y"], b["t"], strict=True):
                words = t.split()
                # the whole text, and a few of its words, so that short texts are known too
                for whole, part in ((True, t), (False, " ".join(words[len(words) // 2 :][:8]))):
                    kinds, counts = np.unique(buckets(part), return_counts=True)
                    if len(kinds):
                        out.append((y, kinds.astype("<u2").tobytes(), counts.astype("<f4").tobytes(), whole))
            yield pd.DataFrame(out, columns=["y", "k", "c", "w"])

    # as Arrow columns, and in their small types: the driver holds each sampled count once
    got = texts.mapInPandas(counted, "y string, k binary, c binary, w boolean").toArrow().to_pydict()
    rows = [(y, np.frombuffer(k, "<u2"), np.frombuffer(c, "<f4"), w) for y, k, c, w in zip(got["y"], got["k"], got["c"], got["w"], strict=True)]
    return sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes(), r[3]))


def train(labelled: DataFrame, calibration: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A calibrated model from two disjoint labelled tables; rows with null text or label are left out."""
    small_batches(labelled.sparkSession)
    rows = _sample(labelled, id_col, text_col, label_col, "train", per_language)
    if not rows:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    model = fit(rows)
    rows.clear()  # the driver holds one sample at a time
    return calibrate(model, _sample(calibration, id_col, text_col, label_col, "calibrate", per_language))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for each whole text.

    Null texts, texts without a letter, and all texts under a model that was fitted on no
    rows are ``und`` with score 0 and rejected. Other texts are rejected when their score is
    below the calibrated threshold. Other columns are kept; repeated rows have equal results;
    texts may be of any length; no rows give no rows; no shuffle.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        rows = [m.predict(t) for t in texts]
        return pd.DataFrame([(c, s, c == UNDETERMINED or s < m.threshold) for c, s in rows], columns=["lang_pred", "score", "rejected"])

    # else a filter on its columns is pushed below it, and each text is judged twice, by two workers of a task
    predicted = predicted.asNondeterministic()
    names = ["lang_pred", "score", "rejected"]
    rows, back = apart(docs.drop(*names), text_col)
    return back(rows.withColumn("__p", predicted(F.col(text_col))).select(*rows.columns, "__p.*"))


def risk(identified: DataFrame, label_col: str = "lang", thresholds: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """``threshold, coverage, error``: of rows with a label, the share accepted at a threshold and the share of these that is wrong."""
    rows = identified.where(F.col(label_col).isNotNull()).select("score", (F.col("lang_pred") != F.col(label_col)).alias("wrong"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    taken = F.col("score") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.avg(taken.cast("double")).alias("coverage"), F.avg(F.when(taken, F.col("wrong").cast("double"))).alias("error"))


def fold(id_col: str = "doc_id"):
    """The fold of a row: crc32 of its id's text, modulo 3. Fold 1 is never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on fold 0 and calibrate on fold 2; fold 1 stays held out."""
    return train(docs.where(fold(id_col) == 0), docs.where(fold(id_col) == 2), id_col, text_col, label_col, per_language)
