"""Quality scores from compression with dictionaries of good and of bad text.

Text that resembles the good examples compresses better with a dictionary built
from them. The difference of the two compressed sizes, normalised, is turned into
the probability of label 1 by a small calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vecspark.llm.support import ship_package

#: Bounds of the training sample: labelled rows of each class, and the longest text used for training.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Texts are compressed in blocks, so that the dictionary matters for every part of a long one.
BLOCK_BYTES = 2048
FEATURES = 6
#: A document with a lower score is rejected.
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    empty: float  # score of a text without content


class Sizer:
    """Compressed sizes of whole texts under both dictionaries and under none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        self.packers = [zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]
        for data in (good, bad):
            dictionary = zstd.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            self.packers.append(
                zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, raw: bytes) -> tuple[int, int, int]:
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        plain, good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self.packers)
        return plain, good, bad


def features(raw: bytes, sizer: Sizer) -> np.ndarray:
    """The normalised difference, how compressible the text is, their squares and product."""
    plain, good, bad = sizer.sizes(raw)
    difference = (bad - good) / (bad + good)
    density = min(1.0, plain / len(raw))
    length = np.log1p(len(raw)) / 10
    return np.array([difference, difference * abs(difference), density, density * density, difference * density, length])


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps, halved until the penalised loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, now = np.linalg.solve(curvature, gradient), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as zstd

    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too few or too uniform examples to train on
        return b"\n".join(texts)[-DICTIONARY_BYTES:] or b" "


def fit(examples: list[tuple[bytes, int]], share_of_good: float) -> QualityModel:
    """Dictionaries from one half of the examples, calibration from the other.

    ``share_of_good`` is the rate of label 1 among all labelled rows: the sample takes
    both classes alike, and the intercept is shifted back to that rate.
    """
    examples = [(t, y) for t, y in examples if t.strip()]
    halves = examples[::2], examples[1::2]
    good, bad = (_dictionary([t for t, y in halves[0] if y == label]) for label in (1, 0))
    y = np.array([y for _, y in halves[1]], float)
    prior = min(max(share_of_good, 1e-3), 1 - 1e-3)
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(good, bad, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), np.log(prior / (1 - prior))], prior)
    sizer = Sizer(good, bad)
    x = np.array([features(t, sizer) for t, _ in halves[1]])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _fit_logistic((x - mean) / scale, y)
    seen = y.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return QualityModel(good, bad, mean, scale, w, prior)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fit on a bounded sample: ``rows`` labelled documents of each class, first by a hash of the id.

    Only labelled rows outside the held-out fold are read for it. An id that bears both labels is left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, chars))
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(4 * rows).collect()
    total = sum(counts.values())
    return fit([(r["text"].encode(), r["quality"]) for r in sample], counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The columns of ``docs`` with ``score`` added: the probability of label 1 from the whole text.

    A null, empty or blank text gets the rate of label 1 among all labelled rows. Rows are independent, so
    repeated ones give equal results. A column ``score`` of ``docs`` is replaced.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for batch in batches:
            out = np.full(batch.num_rows, model.empty)
            for i, text in enumerate(batch.column(at)):
                raw = text.as_py()
                raw = raw.encode() if raw else b""
                if raw.strip():
                    z = (features(raw, sizer) - model.mean) / model.scale
                    out[i] = 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=batch.schema.append(pa.field("score", pa.float64())))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))

