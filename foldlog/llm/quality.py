"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled good texts; the unlabelled set is web text without a label. A classifier of
positive against unlabelled gives the class prior: the smallest ratio of the tails of its scores, as at a high
enough cut nearly all that is left of the unlabelled set is positive. The scorer then minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

by Adam over binned features of a text; where the second term turns negative, the step goes against it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import held_out, small_batches

#: Trusted positives and unlabelled texts that the model is fitted on, at most each.
TRAIN_ROWS = 8_000
BINS = 12
STEPS = 400
FEATURES = 20


def features(text: str) -> list[float]:
    """Shares of kinds of characters, of repeated words and lines, and sizes; all zero for an empty text."""
    if not text:
        return [0.0] * FEATURES
    n = len(text)
    raw = text.encode("utf-32-le")
    codes = np.frombuffer(raw, dtype="<u4")
    low = np.bincount(np.minimum(codes, 128), minlength=129)
    upper = low[65:91].sum()
    lower = low[97:123].sum() + low[128]
    words = text.split()
    counts = Counter(words)
    m = max(1, len(words))
    top = counts.most_common(1)[0][1] if counts else 0
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    marks = low[33:48].sum() + low[58:65].sum() + low[91:97].sum() + low[123:127].sum()
    data = text.encode()
    return [
        np.log1p(n), np.log1p(m), n / m, upper / n, lower / n, low[48:58].sum() / n, marks / n, low[ord("|")] / n,
        low[ord("!")] / n, (low[ord(".")] + low[ord(",")]) / n, low[35:43].sum() / n, low[10] / n, low[128] / n,
        len(counts) / m, top / m, same / m, len(set(lines)) / max(1, len(lines)), len(zlib.compress(data, 1)) / len(data),
        sum(map(str.isalpha, words)) / m, np.log1p(m) * len(counts) / m,
    ]


class Binned:
    """Features as indicators of quantile bins, so that a linear score can bend."""

    def __init__(self, x: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        self.width = sum(len(e) + 1 for e in self.edges) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(x), self.width), dtype=np.float32), 0
        for k, e in enumerate(self.edges):
            out[np.arange(len(x)), at + np.searchsorted(e, x[:, k], side="right")] = 1
            at += len(e) + 1
        out[:, -1] = 1
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def adam(gradient, width: int, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among u: smallest ratio of tails, at cuts that keep enough of both to be sure.

    p, u: scores of held-back positive and unlabelled rows by a classifier of one against the other.
    """
    p, u = np.sort(p), np.sort(u)
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    tail = lambda a: 1 - np.searchsorted(a, cuts, side="left") / len(a)
    slack = np.sqrt(np.log(20) / (2 * len(p))) + np.sqrt(np.log(20) / (2 * len(u)))
    best = int(np.argmin((tail(u) + slack) / tail(p)))
    return float(np.clip(tail(u)[best] / tail(p)[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray) -> tuple[Binned, np.ndarray, float]:
    """(bins, weights, prior) of the scorer, from features of positives and of unlabelled rows."""
    bins = Binned(np.vstack([p, u]))
    xp, xu = bins(p), bins(u)
    half = lambda x: (x[::2], x[1::2])
    (p1, p2), (u1, u2) = half(xp), half(xu)

    def apart(w: np.ndarray) -> np.ndarray:
        return -p1.T @ (1 - sigmoid(p1 @ w)) / len(p1) + u1.T @ sigmoid(u1 @ w) / len(u1) + 1e-3 * w

    w = adam(apart, bins.width, 150)
    prior = estimated_prior(p2 @ w, u2 @ w)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(xp @ w), sigmoid(xu @ w)
        negative = np.mean(np.logaddexp(0, xu @ w)) - prior * np.mean(np.logaddexp(0, xp @ w))
        g_negative = xu.T @ su / len(xu) - prior * xp.T @ sp / len(xp)
        if negative < 0:
            return -g_negative
        return -prior * xp.T @ (1 - sp) / len(xp) + g_negative + 1e-4 * w

    return bins, adam(risk, bins.width), prior


def text_features(column: str) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "") for t in texts])

    return of(F.col(column))


def score_quality(df: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Adds out_col: STRUCT<score, predicted, prior>.

    Positives: at most train_rows texts labelled 1 outside the fold. Unlabelled: at most train_rows texts with
    no row in `labels`, or, where there are none, all labelled ones outside the fold with their labels set
    aside. Both are chosen by a hash of the id; only their features come to the driver. Nulls: a null text
    counts as empty, and is scored like any other. Without positives or unlabelled texts every score is the
    prior 0.5. Long texts are read whole; ties and repeated rows score alike; other columns stay; empty in,
    empty out.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("y"))
    usable = known.where(~held_out(F.col("id"), folds, fold))

    def picked(ids: DataFrame) -> np.ndarray:
        chosen = ids.orderBy(F.xxhash64("id"), "id").limit(train_rows)
        # a row an id, its least text: what comes to the driver is bounded however often ids repeat
        one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        rows = one.select("id", text_features("text").alias("x")).toPandas().sort_values("id", kind="stable")
        return np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), FEATURES)

    p = picked(usable.where("y = 1").select("id"))
    u = picked(texts.select("id").join(known, "id", "left_anti"))
    if not len(u):
        u = picked(usable.select("id"))
    if len(p) < 4 or len(u) < 4:
        return df.withColumn(out_col, F.struct(F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"), F.lit(0.5).alias("prior")))
    bins, w, prior = fit(p, u)

    @F.pandas_udf("score double, predicted int, prior double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.array([features(t or "") for t in rows], dtype=float).reshape(len(rows), FEATURES)
            s = sigmoid(bins(x) @ w)
            yield pd.DataFrame({"score": s, "predicted": (s >= threshold).astype("int32"), "prior": prior})

    return df.withColumn(out_col, score(F.col(text_col)))
