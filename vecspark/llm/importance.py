"""Importance resampling towards a target text set, with bit-sliced sums.

Features are word runs, hashed into buckets. A bucket's gain is the logarithm of how much likelier
it is in the target than in the corpus, as an integer. The weight of a document is the mean gain
of its features: its bucket counts are cut into bit planes, each plane is met with the bit planes
of the gains, and population counts, weighed by powers of two, add up to the exact integer sum.
Documents are drawn by weight with Gumbel noise that a hash of their id gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vecspark.llm.support import BROADCAST_IDS, write_step
from vecspark.llm.textscan import text_buffer

BUCKETS = 10_000
#: Features are runs of up to so many words.
LONGEST_RUN = 1
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words whose buckets a task remembers, and bytes of text cut into words at once.
REMEMBERED = 500_000
SLICE_BYTES = 1 << 20
#: Scores in one band; there is a handful of bands, as scores have a narrow range.
BAND = 512
#: Documents whose counts are sliced at once.
BLOCK = 256

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, and makes the rest spaces.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


class Buckets(dict):
    """Bucket of a feature's bytes; remembers a bounded number of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, cut at spaces into lists from about SLICE_BYTES of text."""
    at = 0
    while at < len(raw):
        end = len(raw) if at + SLICE_BYTES >= len(raw) else raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_buckets(raw: bytes, known: Buckets, longest: int) -> Iterator[np.ndarray]:
    """Buckets of all features of one text, in parts: runs of 1 to ``longest`` words joined by a space."""
    tail: list[bytes] = []
    for words in _slices(raw.translate(_WORD_BYTES)):
        yield np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if longest > 1:
            joined = tail + words
            for width in range(2, longest + 1):
                first = max(0, len(tail) - width + 1)
                runs = [b" ".join(joined[i : i + width]) for i in range(first, len(joined) - width + 1)]
                yield np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
            tail = joined[-(longest - 1) :]


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    raw, bounds = text_buffer(batch.column(at))
    for i in range(batch.num_rows):
        yield raw[bounds[i] : bounds[i + 1]].tobytes()


def _totals(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                for part in feature_buckets(text, known, longest):
                    counts += np.bincount(part, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket; a task adds up its texts before anything is shuffled."""
    return docs.select("text").mapInArrow(_totals(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket from the two tables of totals."""
    spark = corpus.sparkSession

    def whole(totals: DataFrame, name: str, total: str) -> DataFrame:
        filled = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(totals), "bucket", "left")
        filled = filled.select("bucket", F.coalesce("n", F.lit(0)).cast("double").alias(name))
        return filled.join(F.broadcast(totals.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(total))))

    sides = whole(corpus, "held", "all_held").join(whole(target, "wanted", "all_wanted"), "bucket")
    ratio = (F.col("wanted") + 1) * (F.col("all_held") + buckets) / ((F.col("held") + 1) * (F.col("all_wanted") + buckets))
    return sides.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    words = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    return np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)


class GainPlanes:
    """Integer gains as bit planes of their positive and of their negative values."""

    def __init__(self, gain: np.ndarray):
        self.planes = []
        for sign in (1, -1):
            size = np.maximum(sign * gain, 0)
            for k in range(int(size.max(initial=0)).bit_length()):
                self.planes.append((sign, k, packed(((size >> k) & 1)[None, :])[0]))

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """For each row of bucket counts the exact sum of count times gain."""
        totals, most = np.zeros(len(counts), np.int64), counts.max(axis=1, initial=0)
        for j in range(int(most.max(initial=0)).bit_length()):
            rows = np.flatnonzero(most >> j)
            plane = packed((counts[rows] >> j) & 1)
            for sign, k, gain in self.planes:
                met = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                totals[rows] += sign * (met << (j + k))
        return totals


def _weights(shared, buckets: int, longest: int):
    """``mapInArrow`` body for ``(doc_id, text)``: doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, planes = Buckets(buckets), GainPlanes(shared.value)
        for batch in batches:
            counts, n_features, weight = np.zeros((BLOCK, buckets), np.int32), [], []
            for text in _texts(batch, 1):
                row = len(n_features) % BLOCK
                for part in feature_buckets(text, known, longest):
                    counts[row] += np.bincount(part, minlength=buckets).astype(np.int32)
                n_features.append(int(counts[row].sum(dtype=np.int64)))
                if row == BLOCK - 1:
                    weight += planes.sums(counts).tolist()
                    counts[:] = 0
            left = len(n_features) - len(weight)
            weight += planes.sums(counts[:left]).tolist()
            mean = [w // n if n else 0 for w, n in zip(weight, n_features)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_features, pa.int64()), pa.array(mean, pa.int64())],
                names=["doc_id", "n_features", "weight"],
            )

    return run


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """``(doc_id, n_features, weight)`` per row of ``docs (doc_id, text)`` against ``target (text)``.

    The gains of all buckets reach the driver, which sends them to the tasks: their number is a
    parameter and does not grow with the input. A null or empty text has no feature and weight 0.
    """
    table = gains(
        write_step(bucket_totals(docs, buckets, longest), "corpus-buckets"),
        write_step(bucket_totals(target, buckets, longest), "target-buckets"),
        buckets,
    ).toArrow()
    gain = np.zeros(buckets, np.int64)
    gain[table.column("bucket").to_numpy()] = table.column("gain").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _weights(shared, buckets, longest), f"doc_id {ids}, n_features long, weight long"
    )


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash; a null id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, one row per row of ``docs``.

    ``rank`` is 1, 2, 3 ... for the documents drawn, by falling score and then rising id, else
    null. Drawn are ``percent`` of a hundred, rounded down, of the documents with at least
    ``least_words`` words. Rows that repeat an id are documents of their own; where they tie, the
    one with fewer features and then the smaller weight comes first. A null id comes last among equal scores. An empty
    table gives an empty result, an empty target gains from the corpus alone; other columns are
    ignored.

    Ranks need no global sort: scores are integers of a narrow range, so documents are counted by
    score, and the running count of higher scores is added to the place within one score.
    """
    least = sum(max(0, least_words - width + 1) for width in range(1, longest + 1))  # features of so many words
    able = F.col("n_features") >= least
    scored = weigh(docs, target, buckets, longest).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = write_step(scored.withColumn("able", able), "scored")
    counted = scored.where("able").groupBy("score").agg(F.count("*").alias("n"))
    counted = write_step(counted.withColumn("band", F.floor(F.col("score") / BAND)), "counted")
    down, rows = W.partitionBy(F.lit(0)).orderBy(F.col("band").desc()), (W.unboundedPreceding, -1)
    bands = counted.groupBy("band").agg(F.sum("n").alias("n"))
    bands = bands.select("band", F.coalesce(F.sum("n").over(down.rowsBetween(*rows)), F.lit(0)).alias("above"))
    inside = W.partitionBy("band").orderBy(F.col("score").desc()).rowsBetween(*rows)
    before = counted.join(F.broadcast(bands), "band").select(
        "score", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")
    )
    limit = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()["all"] * percent // 100
    reached = write_step(before.where(F.col("before") < limit), "reached")
    if reached.count() <= BROADCAST_IDS:
        reached = F.broadcast(reached)
    within = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    chosen = scored.where("able").join(reached, "score").withColumn("rank", (F.col("before") + F.row_number().over(within)).cast("long"))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))
    rest = scored.where("NOT able").unionByName(scored.where("able").join(reached.select("score"), "score", "left_anti"))
    names = ["doc_id", "n_features", "weight", "score"]
    return chosen.select(*names, "rank").unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))
