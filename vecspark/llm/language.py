"""Language identification in two levels.

A first set of linear classifiers picks the language family; within a family,
one-versus-one linear support vector machines vote between the related languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from vecspark.llm.support import BROADCAST_IDS, ship_package

#: Families of languages (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
    "malayic": ("id", "ms"),
}
UNKNOWN = "und"
DIM = 4096
GRAMS = (1, 2, 3, 4)
#: Bounds of the training sample: rows of one language, rows in all, and the longest text used for training.
SAMPLE_ROWS = 1000
SAMPLE_TOTAL = 6000
SAMPLE_CHARS = 20_000
#: Rows drawn of a language by hash, as a multiple of those wanted, before the first of them are taken.
MARGIN = 4
CHUNK = 1 << 18

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def profile(text: str | None) -> np.ndarray | None:
    """Hashed character 1- to 4-grams of the whole text, damped and of unit length; None without a letter."""
    if not text:
        return None
    counts, seen = np.zeros(DIM), False
    for at in range(0, len(text), CHUNK):
        # three characters of overlap keep the grams that cross a cut
        points = np.frombuffer(text[max(0, at - 3) : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter_table()[points]
        seen = seen or bool(letter.any())
        points = np.where(letter, points, np.uint32(32))
        points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
        points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.uint32)
        code = np.zeros(len(points), np.uint32)
        for n in GRAMS:
            if len(points) < n:
                break
            code = code[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            counts += np.bincount(mixed >> np.uint32(20), minlength=DIM)
    if not seen:
        return None
    damped = np.log1p(counts)
    return damped / np.linalg.norm(damped)


@dataclass(frozen=True)
class LanguageModel:
    families: list[list[str]]
    family_weights: np.ndarray  # a row per family
    pairs: list[tuple[str, str]]
    pair_weights: np.ndarray  # a row per pair; positive speaks for the first

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        margins = self.family_weights @ x
        odds = np.exp(np.clip(4 * (margins - margins.max()), -50, 0))
        family = int(margins.argmax())
        members = self.families[family]
        sure = float(odds[family] / odds.sum())
        if len(members) == 1:
            return members[0], sure
        votes = {m: [0, 0.0] for m in members}
        for (a, b), w in zip(self.pairs, self.pair_weights):
            if a in votes:
                chance = 1 / (1 + np.exp(-np.clip(4 * float(w @ x), -50, 50)))
                votes[a][0] += chance >= 0.5
                votes[b][0] += chance < 0.5
                votes[a][1] += chance
                votes[b][1] += 1 - chance
        best = max(sorted(members), key=lambda m: votes[m])
        return best, sure * float(votes[best][1]) / (len(members) - 1)


def linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, strength: float = 1e-4) -> np.ndarray:
    """Hinge loss by stochastic subgradient steps over balanced classes; averaged weights, intercept last."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    rng = np.random.default_rng(7)
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum()))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for block in np.array_split(order, max(1, len(x) // 32)):
            t += 1
            wrong = y[block] * (x[block] @ w) < 1
            step = 1 / (strength * (t + 1 / strength / 10))
            pull = ((weight[block] * y[block])[:, None] * x[block])[wrong].sum(0) / len(block)
            w = (1 - step * strength) * w + step * pull
            mean += (w - mean) * 2 / (t + 1)
    return mean


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"only {language}")


def fit(x: np.ndarray, languages: list[str]) -> LanguageModel | None:
    known = sorted(set(languages))
    if not known:
        return None
    names = sorted({family_of(k) for k in known})
    families = [[k for k in known if family_of(k) == n] for n in names]
    languages_of = np.array(languages)
    if len(names) == 1:
        family_weights = np.zeros((1, DIM + 1))
    else:
        family_weights = np.array([linear_svm(x, np.where(np.isin(languages_of, m), 1.0, -1.0)) for m in families])
    pairs, weights = [], []
    for members in families:
        for a, b in combinations(members, 2):
            own = np.isin(languages_of, [a, b])
            pairs.append((a, b))
            weights.append(linear_svm(x[own], np.where(languages_of[own] == a, 1.0, -1.0)))
    return LanguageModel(families, family_weights, pairs, np.array(weights).reshape(len(pairs), DIM + 1))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> LanguageModel | None:
    """Fit on a bounded sample outside the held-out fold: of each language the first ``rows`` by a hash of id and text.

    ``total`` bounds the rows of all languages, but each gets ten at least, however many there are: every
    language that occurs with a text of 1 to SAMPLE_CHARS characters is learned. Of a language whose rows are
    mostly copies of each other fewer may be drawn.
    """
    ship_package(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.length("text").between(1, SAMPLE_CHARS) & ~held_out()
    )
    held = usable.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("held"))
    known = held.count()
    if not known:
        return None
    each = max(10, min(rows, total // known))
    # a share of a large language by hash, about MARGIN times what is wanted, and equal rows once: no group is large
    drawn = (
        usable.select(F.col("lang").alias("of"), F.xxhash64("doc_id", "text").alias("order"))
        .join(F.broadcast(held) if known <= BROADCAST_IDS else held, "of")
        .where(F.pmod("order", "held") < MARGIN * each).select("of", "order").distinct()
    )
    first = W.partitionBy("of").orderBy("order")
    sample = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).drop("place")
    chosen = usable.join(F.broadcast(sample), (F.xxhash64("doc_id", "text") == F.col("order")) & (F.col("lang") == F.col("of"))).select(
        "lang", "text", "order"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, orders, out = [], [], []
            for lang, text, order in zip(*(c.to_pylist() for c in batch.columns)):
                found = profile(text)
                if found is not None:
                    langs.append(lang), orders.append(order), out.append(found.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(orders, pa.int64()), pa.array(out, pa.binary())], ["lang", "order", "x"])

    got = sorted(chosen.mapInArrow(run, "lang string, order long, x binary").collect(), key=lambda r: (r["order"], r["lang"]))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in got], np.float32).reshape(len(got), DIM)
    return fit(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1) added, from whole texts.

    A null or empty text, one without a letter, and any text if nothing could be
    learned, get ``und`` with score 0. Rows are independent, so repeated ones give equal results.
    Columns of ``docs`` with the names of the added ones are replaced by them.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(at):
                x = profile(text.as_py()) if model is not None else None
                found.append((UNKNOWN, 0.0) if x is None else model.predict(x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=batch.schema.append(pa.field("lang_pred", pa.string())).append(pa.field("score", pa.float64())),
            )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
