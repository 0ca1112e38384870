"""Quality classifier by positive-unlabelled learning with the non-negative risk (Kiryo et al.).

Trusted positives are training rows labelled 1; unlabelled text is any training row of the corpus,
whatever its label. A linear scorer on surface features minimises

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with the logistic loss; when the second term turns negative, its gradient step is reversed. The
prior is estimated from the same two samples: a first scorer tells positives from unlabelled rows,
and the smallest ratio of (unlabelled share) / (positive share) above a threshold of its score, on
the half that it was not fitted on, bounds the prior from above (best bin estimation).

Fitting uses the MAX_POSITIVE and MAX_UNLABELLED rows of the smallest seeded hashes of the id, exactly so many
of any larger table; scoring covers every whole text and runs in Arrow batches.

Defined cases: null and empty texts are scored as text without features; texts of any length are read
whole; ids that repeat are scored row by row, and equal texts have equal scores; a score of exactly the
threshold is kept; an id labelled both 1 and 0 counts as labelled 1; without any trusted positive every
score is 1 (nothing can be told to be worse); an empty table gives no rows; other columns are ignored by
`score`, and carried through by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fold, least_hashes, settle

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
FOLDS = 5
PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
EPOCHS = 400
SIZE = len(PUNCT) + 16  # of a feature vector
SLICE = 512  # rows of a batch whose texts are Python objects at a time


def features(text: str | None) -> np.ndarray:
    """Surface features of a whole text, whatever its length and language."""
    out = np.zeros(SIZE, dtype=np.float32)
    if not text or text.isspace():
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    byte = np.bincount(raw, minlength=256)
    n = len(raw)
    upper, lower, digit = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
    space = byte[32] + byte[9:14].sum()
    words = text.split()
    k = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(eq, words, words[1:]))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=k)
    own = len(set(words))
    out[: len(PUNCT)] = np.sqrt(byte[PUNCT] / n)
    out[len(PUNCT) :] = (
        upper / max(1, upper + lower),
        digit / n,
        space / n,
        byte[128:].sum() / n,
        byte[:9].sum() / n + byte[14:32].sum() / n,
        np.log1p(k),
        sizes.mean() / 10,
        min(4.0, sizes.std() / 10),
        (sizes <= 2).mean(),
        (sizes >= 20).mean(),
        same / k,
        own / k,
        np.log1p(own) / np.log1p(k),
        1 - len(set(lines)) / max(1, len(lines)),
        min(4.0, np.log1p(k / max(1, len(lines)))) / 4,
        byte[PUNCT].sum() / k,
    )
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            x = np.concatenate([features(t.as_py()) for t in part.column("text")])
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * SIZE, pa.array(x))], ["h", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, size: int, epochs: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, epochs + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows; rows are standardised features."""
    fit_p, fit_u, p, u = p[::2], u[::2], p[1::2], u[1::2]
    if not len(fit_p) or not len(fit_u) or not len(p) or not len(u):
        return 0.9

    def grad(w: np.ndarray) -> np.ndarray:
        a, b = _sigmoid(-(fit_p @ w)), _sigmoid(fit_u @ w)
        return -(fit_p.T @ a) / len(fit_p) + fit_u.T @ b / len(fit_u) + 1e-3 * w

    w = _adam(grad, p.shape[1], EPOCHS // 2)
    sp, su = np.sort(p @ w), np.sort(u @ w)
    at = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    q_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    q_u = 1 - np.searchsorted(su, at, "left") / len(su)
    slack = np.sqrt(np.log(20) / (2 * len(sp))) + np.sqrt(np.log(20) / (2 * len(su)))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray) -> dict:
    """Weights, centre, scale and prior from features of positives and of unlabelled rows."""
    centre = u.mean(axis=0)
    scale = u.std(axis=0) + 1e-3

    def lift(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])

    p, u = lift(p), lift(u)
    prior = estimate_prior(p, u)

    def grad(w: np.ndarray) -> np.ndarray:
        return nn_risk(p, u, w, prior)[1] + 1e-4 * w

    return {"w": _adam(grad, p.shape[1], EPOCHS), "centre": centre, "scale": scale, "prior": prior}


def nn_risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of a linear scorer and the gradient of the step that is taken.

    Where the second term is negative, the step climbs it instead (its descent direction reversed).
    """
    fp, fu = p @ w, u @ w
    pos = prior * np.logaddexp(0, -fp).mean()
    rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    d_pos = -prior * (p.T @ _sigmoid(-fp)) / len(p)
    d_rest = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
    return pos + max(0.0, rest), d_pos + d_rest if rest >= 0 else -d_rest


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the `most` rows (id, text) with the smallest hashes of the id; of equal ids, the smallest features."""
    picked = least_hashes(rows, F.xxhash64(F.lit(4), "id"), most, "h").select("h", "text")
    got = picked.mapInArrow(_feature_rows, "h long, x array<float>").orderBy("h", "x").limit(most).select("x").collect()
    return np.array([r.x for r in got], dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """The model, or None without positives. Learns from ids outside the held-out fold only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(fold(F.col("id"), FOLDS) != 0)
    good = labels.filter((F.col(label_col) == 1) & (fold(F.col(id_col), FOLDS) != 0)).select(F.col(id_col).alias("id"))
    # of the documents' own ids, however many more the labels have
    good = settle(good.distinct().join(rows.select("id"), "id", "left_semi"))
    good = least_hashes(good, F.xxhash64(F.lit(4), "id"), MAX_POSITIVE, "h").orderBy("h", "id").limit(MAX_POSITIVE).select("id")
    p = _sample(rows.join(F.broadcast(good), "id", "left_semi"), MAX_POSITIVE)
    u = _sample(rows, MAX_UNLABELLED)
    return fit(p, u) if len(p) and len(u) else None


def score_column(model: dict | None):
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.ones(len(texts)))
        out = np.empty(len(texts))
        for at in range(0, len(texts), SLICE):
            x = np.array([features(t.as_py()) for t in texts.slice(at, SLICE)], dtype=np.float64)
            z = np.clip((x - model["centre"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1]
            out[at : at + SLICE] = _sigmoid(z)
        return pa.array(out)

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id and score (probability of quality 1) of every row."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.select(F.col(id_col), score_column(model)(F.col(text_col)).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that score at least `least`, with their own columns."""
    model = train(docs, labels, id_col, text_col, label_col)
    good: Column = score_column(model)(F.col(text_col)) >= least
    return docs.filter(good)
