"""Quality by naive Bayes support vectors.

Features are indicators of token unigrams and bigrams (runs of word characters, runs of other signs), hashed
into 2**bits columns. Each column is scaled by its log-count ratio between the classes, dual coordinate
descent fits the hinge loss on the scaled indicators, and a logistic curve fitted on a fold left out of the
fit turns margins into scores.

Edge cases: a null or empty text has no feature and gets the score of the bias. Without labelled rows of both
classes every score is the training share of label 1 (0.0 without any label). Repeated label rows count as
label 1 if one of them does; labels without a document, null labels and null ids are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import K1, Hashes, arrow_pass, mix
from millrace.llm.toxicity import labelled, logistic

EPOCHS = 5_000  # far more than the fit ever takes; it is an error to get there
TOKENS = re.compile(r"\w+|[^\w\s]+")


@dataclass
class NbSvm:
    weights: np.ndarray  # hinge weight times log-count ratio, by column
    bias: float
    curve: tuple[float, float]
    bits: int


def features(texts: list, memo: Hashes, bits: int) -> list[np.ndarray]:
    """The distinct columns of each text."""
    shift, out = np.uint64(64 - bits), []
    for t in texts:
        h = memo.of(TOKENS.findall(t)) if t else np.zeros(0, np.uint64)
        both = np.concatenate([mix(h), mix(h[:-1] * K1 + h[1:])]) >> shift
        out.append(np.unique(both.astype(np.uint32)))
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int, *, c: float = 1.0, gap: float = 1e-3, alpha: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Log-count ratios, then dual coordinate descent for the hinge loss, until primal and dual objective are within
    gap of each other (as a share of the primal); gives (weights, bias)."""
    width = 1 << bits
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == v] or [np.zeros(0, np.uint32)]), minlength=width).astype(float) + alpha for v in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = np.zeros(width), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    x = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    q = np.array([v @ v + 1.0 for v in x])
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    flat, starts = np.concatenate([*rows, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
    values, full = np.concatenate([*x, np.zeros(0)]), np.array([len(r) > 0 for r in rows])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ x[i] + bias) - 1.0
            new = min(c, max(0.0, dual[i] - g / q[i]))
            d = (new - dual[i]) * sign[i]
            if d:
                w[rows[i]] += d * x[i]
                bias += d
                dual[i] = new
        m = np.full(len(rows), bias)
        if full.any():
            m[full] += np.add.reduceat(w[flat] * values, starts[full])
        half = (w @ w + bias * bias) / 2
        primal = half + c * np.maximum(0, 1 - sign * m).sum()
        if primal - (dual.sum() - half) <= gap * primal:
            break
    else:
        raise RuntimeError(f"the hinge loss isn't minimal after {EPOCHS} epochs")
    return w * ratio, bias


def margin(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    n = np.array([len(r) for r in rows])
    total, full = np.zeros(len(rows)), np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(weights[np.concatenate(rows)], np.concatenate([[0], np.cumsum(n[full])[:-1]]))
    return total / np.sqrt(np.maximum(n, 1)) + bias


def train(docs: DataFrame, labels: DataFrame, train_on: Column, *, label: str = "quality", quota: tuple[int, int] = (3000, 3000), bits: int = 18, calibration_fold: int = 4, text: str = "text", key: str = "doc_id") -> NbSvm | float:
    """Fits on a bounded sample: quota is the documented bound (rows of label 0, rows of label 1).

    Gives a float, the share of label 1, when a class is missing.
    """
    rows, sizes = labelled(docs, labels, train_on, label, quota, text=text, key=key)
    total = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        return sizes.get(1, 0) / total if total else 0.0
    memo = Hashes()

    def part(batch):
        yield {"fold": batch.column(0), "label": batch.column(1), "columns": [r.astype(np.int32) for r in features(batch.column(2).to_pylist(), memo, bits)]}

    found = arrow_pass(rows.select("fold", "label", "text"), part, "fold int, label int, columns array<int>").toArrow()
    fold, y = found["fold"].to_numpy(), found["label"].to_numpy()
    x = [np.asarray(v, np.uint32) for v in found["columns"].combine_chunks().to_numpy(zero_copy_only=False)] if len(y) else []
    # one order whatever order the rows come in
    order = sorted(range(len(x)), key=lambda i: (y[i], len(x[i]), x[i].tobytes()))
    x, y, fold = [x[i] for i in order], y[order], fold[order]
    fitted = fold != calibration_fold
    if len(set(y[fitted])) < 2:
        return sizes[1] / total
    weights, bias = fit([r for r, k in zip(x, fitted) if k], y[fitted], bits)
    held = [r for r, k in zip(x, fitted) if not k]
    yh = y[~fitted].astype(float)
    if len(set(yh)) < 2:
        return NbSvm(weights.astype(np.float32), bias, (1.0, 0.0), bits)
    weight = np.where(yh == 1, sizes[1] / yh.sum(), sizes[0] / (1 - yh).sum())
    m = margin(held, weights, bias)
    curve = logistic(np.stack([m, np.ones(len(m))], axis=1), yh, weight / weight.mean())
    return NbSvm(weights.astype(np.float32), bias, (float(curve[0]), float(curve[1])), bits)


def score(docs: DataFrame, model: NbSvm | float, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """keep's columns and score double (0 to 1) of each row's whole text."""
    if isinstance(model, float):
        return docs.select(*[c.alias(n) for n, c in keep.items()], F.lit(model).alias("score"))
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    names = list(keep)
    memo = Hashes()

    def part(batch):
        rows = features(batch.column(batch.num_columns - 1).to_pylist(), memo, model.bits)
        z = model.curve[0] * margin(rows, model.weights, model.bias) + model.curve[1]
        yield {n: batch.column(i) for i, n in enumerate(names)} | {"score": 1 / (1 + np.exp(-np.clip(z, -60, 60)))}

    return arrow_pass(kept, part, "score double", kept.schema.fields[:-1])
