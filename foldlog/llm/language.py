"""Language identification with string kernels.

The kernel of two texts is the cosine of their sets of character n-grams of 1 to 4 (blended spectrum, presence
only). A few labelled texts are landmarks (Nyström): a text is represented by its kernel values with them, times
the inverse square root of the landmarks' own kernel matrix. One-versus-rest kernel ridge regression in that
space scores each language; a batch of texts is scored by matrix products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.llm.common import held_out, small_batches

#: Labelled texts for the regression, and landmarks among them, at most.
TRAIN_ROWS, LANDMARKS = 3_000, 160
#: Buckets of n-gram hashes. A power of two.
BUCKETS = 8_192
RIDGE = 1e-2
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def spectrum(text: str) -> np.ndarray | None:
    """Buckets of the n-grams that the lower-cased text holds; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    keep = is_letter | np.append(True, is_letter[:-1])
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    seen = np.zeros(BUCKETS, dtype=bool)
    h = codes * np.uint32(0x9E3779B1)
    for n in range(1, 5):
        seen[((h ^ (h >> np.uint32(15))) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(19)] = True
        h = h[:-1] * np.uint32(0x01000193) + codes[n:] * np.uint32(0x9E3779B1) if len(h) > 1 else h[:0]
    return seen


def text_spectrum(column: str) -> Column:
    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [spectrum(t or "") for t in texts]
            yield pd.Series([None if x is None else np.packbits(x).tobytes() for x in found], dtype=object)

    return of(F.col(column))


def rows_of(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)


class KernelRidge:
    """Landmarks and one weight vector a language."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        marks = self._landmarks(langs)
        self.marks = x[marks]
        self.norms = np.sqrt(self.marks.sum(axis=1))
        s, v = np.linalg.eigh(self._kernel(self.marks))
        root = v / np.sqrt(np.maximum(s, 1e-6))
        z = self._kernel(x) @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + RIDGE * len(x) / len(marks) * np.eye(z.shape[1]), z.T @ y)
        self.weights = (root @ w).astype(np.float32)

    def _landmarks(self, langs: list[str]) -> list[int]:
        """As many of each language, in the order given."""
        most = -(-LANDMARKS // len(self.names))
        return [i for name in self.names for i in [k for k, x in enumerate(langs) if x == name][:most]]

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks.T) / np.maximum(np.sqrt(x.sum(axis=1))[:, None] * self.norms[None, :], 1e-6)

    def __call__(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        f = self._kernel(x) @ self.weights
        return [self.names[k] for k in f.argmax(axis=1)], np.clip((f.max(axis=1) + 1) / 2, 0, 1)


def identify_language(df: DataFrame, folds: int = 5, fold: int = 0, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", out_col: str = "language") -> DataFrame:
    """Adds out_col: STRUCT<lang_pred, score>.

    Learns from at most train_rows rows (as many of each language as there are, taken in turn by a hash of
    the id) outside the fold whose lang is not null; only spectra and languages come to the driver. A null
    text, or one without a letter, is `und` with score 0. Texts of any length are read whole. With no
    labelled row all are `und`. Ties go to the first language in name order; repeated rows are scored alike;
    other columns stay; empty in, empty out.
    """
    small_batches(df.sparkSession)
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    labelled = labelled.select(F.xxhash64(id_col, text_col).alias("h"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages = max(1, labelled.select("lang").distinct().count())
    each = max(1, train_rows // languages)
    # the smallest hashes of each language: the borders first, so that no language is ranked in one task
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.least(F.lit(1.0), F.lit(4.0 * each + 100) / F.col("n"))
    drawn = labelled.join(F.broadcast(counts.orderBy("lang").limit(train_rows)), "lang").where(F.pmod("h", F.lit(1 << 20)) < chance * (1 << 20))
    first = drawn.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("lang", "h")
    rows = drawn.join(F.broadcast(first), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("id", "lang", text_spectrum("text").alias("bits")).where("bits is not null").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), bytes(r.bits)))
    if not rows:
        return df.withColumn(out_col, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    model = KernelRidge(rows_of([bytes(r.bits) for r in rows]), [r.lang for r in rows])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [spectrum(t or "") for t in texts]
            at = [k for k, x in enumerate(found) if x is not None]
            pred, score = [UNKNOWN] * len(found), np.zeros(len(found))
            if at:
                langs, s = model(np.array([found[k] for k in at], dtype=np.float32))
                score[at] = s
                for k, x in zip(at, langs):
                    pred[k] = x
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return df.withColumn(out_col, predict(F.col(text_col)))
