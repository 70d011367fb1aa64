"""Quality classifier: kernel ridge by random Fourier features, isotonic calibration.

Statistics of a whole text (byte classes, words, lines) are standardised and
mapped by ``cos(Wx + b)``, whose products approximate a Gaussian kernel.  Each
part of the training sample adds up its normal equations; their sum is solved
once.  Ridge scores of rows kept out of the fit are calibrated by isotonic
regression.  Scoring reads each text once, where it lies.

Labels come from at most ``SAMPLE`` rows; the held-out fold is never read.
Scores keep a thousandth of the ridge score, so ties of a calibrated step stay
in order.

Defined results: null texts are empty; empty texts are scored like any other;
without labels, or with one class only, every score is that class's share
(0.5 if there are no labels); repeated rows get equal scores; an empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import training_sample
from tessera.session import materialise, ship_package

SAMPLE = 30_000
FEATURES = 256
WIDTH = 3.0
RIDGE = 1.0
FIT_SHARE = 0.7
LEAST_SHARE = 1e-3


def _byte_classes() -> np.ndarray:
    """Rows of 0/1 over the 256 byte values, one per class."""
    groups = [bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!?", b"|", b"#$%&*", b"\"'()[]{}<>", b"-_=+/\\~^@:;`", bytes(range(128, 192)), bytes(range(192, 256))]
    out = np.zeros((len(groups), 256))
    for i, g in enumerate(groups):
        out[i, list(g)] = 1
    return out


BYTE_CLASSES = _byte_classes()


def text_statistics(text: str) -> np.ndarray:
    """Statistics of one whole text; all zero-safe, so the empty text has them too."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    n = max(len(data), 1)
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(len(words), 1)
    tally = Counter(words)
    lengths = np.fromiter(map(len, lines), dtype=float, count=len(lines))
    full = [x for x in lines if x]
    return np.concatenate(
        [
            np.sqrt(BYTE_CLASSES @ counts / n),
            [
                np.log1p(len(data)),
                np.log1p(len(words)),
                len(text) / w,
                -(p * np.log2(p)).sum(),
                len(tally) / w,
                max(tally.values(), default=0) / w,
                sum(map(operator.eq, words, words[1:])) / w,
                np.log1p(lengths.mean()),
                len(set(full)) / max(len(full), 1),
                sum(x.endswith((".", "!", "?")) for x in full) / max(len(full), 1),
            ],
        ]
    )


def statistics(texts: list[str]) -> np.ndarray:
    return np.array([text_statistics(t) for t in texts]).reshape(len(texts), -1)


@dataclass
class Model:
    """Everything scoring needs; its size depends on parameters only."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = None

    def map(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        rng = np.random.default_rng(7)
        w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH / np.sqrt(x.shape[1] / 8)
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ w + rng.uniform(0, 2 * np.pi, FEATURES))
        return np.hstack([z * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.ridge(x)
        step = np.clip(np.interp(raw, *self.steps), 0, 1) if len(self.steps[0]) else np.clip(raw, 0, 1)
        return (1 - LEAST_SHARE) * step + LEAST_SHARE / (1 + np.exp(-4 * (raw - 0.5)))


def _sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum of ``of(x, y)`` (an array of ``size``) over the parts of (x, label) rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += of(np.stack(b["x"].to_numpy()), b["label"].to_numpy(dtype=float))
        yield pd.DataFrame({"s": [total]})

    parts = rows.select("x", "label").mapInPandas(part, "s array<double>").collect()
    return np.sum([np.array(r["s"]) for r in parts], axis=0) if parts else np.zeros(size)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """Fit on a bounded sample: moments, normal equations, calibration."""
    ship_package(docs.sparkSession)

    def with_statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["label", "half"]].assign(x=list(statistics(b["text"].tolist())))

    sample = training_sample(docs, labels, label_col, bound, id_col, text_col)
    rows = materialise(sample.mapInPandas(with_statistics, "label int, half double, x array<double>"))
    d = len(text_statistics(""))
    n, pos, *moments = _sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    if n == 0 or pos in (0, n):
        return Model(constant=pos / n if n else 0.5)
    mean = np.array(moments[:d]) / n
    model = Model(mean=mean, scale=np.sqrt(np.maximum(np.array(moments[d:]) / n - mean**2, 1e-8)))
    k = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.map(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(rows.where(F.col("half") < FIT_SHARE), normal, k * k + k)
    penalty = RIDGE * np.eye(k)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(sums[: k * k].reshape(k, k) + penalty, sums[k * k :])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"raw": model.ridge(np.stack(b["x"].to_numpy())), "label": b["label"].astype(float)})

    kept = materialise(rows.where(F.col("half") >= FIT_SHARE).mapInPandas(raw, "raw double, label double"))
    if kept.count():
        fit = IsotonicRegression(featuresCol="raw", labelCol="label").fit(kept)
        model.steps = (fit.boundaries.toArray(), fit.predictions.toArray())
    else:
        model.steps = (np.zeros(0), np.zeros(0))
    return model


def quality_score(model: Model, text: Column) -> Column:
    """Score in [0, 1] of a text by a trained model."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(statistics(texts.tolist())) if len(texts) else [], dtype=float)

    return score(F.coalesce(text, F.lit("")))
