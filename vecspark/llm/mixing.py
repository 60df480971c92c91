"""Mixing sources to target weights by entropy balancing.

Every document gets a rate ``min(cap, prior * exp(tilt of its source))``: of all
rates that meet the word targets of the sources, these are the nearest to the
prior in relative entropy, taken over words. The tilts are the solution of a
convex dual, which Newton steps over the whole size table find. Rates become whole
copies run by run: a run is the documents of a source, a size class and a share
of the hashes, its number of extra copies is rounded from a running sum over the
runs, and the documents with the smallest hashes get them. A last exchange of few documents
per source closes the gap that rounding leaves. So a document's copies follow from its own hash and
a small table of runs, and texts need not be shuffled to be repeated or left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vecspark.llm.support import BROADCAST_IDS, write_step

#: Documents of a source and size class are cut by hash into so many runs for rounding, and into
#: more where all documents divided among them would be more than RUN_ROWS.
SALTS = 64
RUN_ROWS = 100_000
TOLERANCE = 1e-9
#: Newton steps; each changes a tilt by at most 2, so this covers rates from exp(-100).
STEPS = 60


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: float) -> DataFrame:
    """``(source, source_size, target)``: weights 1, 2, 3 repeating by code point, null last.

    Targets share the sum of all sizes by weight; one that would pass ``cap`` times
    its source's size stops there and the excess is shared anew by weight. That is
    the level ``c`` with ``sum(min(cap * size, c * weight)) = sum(size)``: the
    largest of the levels that remain as sources fill up in order of size / weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))  # one row per source
    placed = totals.withColumn(
        "place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    ).select("source", "source_size", (1 + (F.col("place") - 1) % 3).cast("double").alias("weight"))
    filling = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    levels = placed.withColumn("level", left / weights_left)
    return levels.select(
        "source",
        "source_size",
        F.least(cap * F.col("source_size"), F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def _rate(cap: float) -> Column:
    return F.when(F.col("target") > 0, F.least(F.lit(cap), F.col("prior") * F.exp("tilt"))).otherwise(0.0)


def solve_tilts(sized: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Newton steps on the dual: ``targets`` with the tilt at which the rates meet them.

    The gradient of a source is its target less the words its rates give, the
    curvature the words of its documents below the cap. One aggregation over the
    size table makes a step; only the largest relative gap reaches the driver.
    """
    tilts = write_step(targets.withColumn("tilt", F.lit(0.0)), "tilts")
    words = F.col("size") * _rate(cap)
    free = F.col("prior") * F.exp("tilt") < cap
    for _ in range(STEPS):
        sums = (
            sized.join(tilts, sized["source"].eqNullSafe(tilts["source"]))
            .groupBy(tilts["source"])
            .agg(F.sum(words).alias("given"), F.sum(F.when(free, words)).alias("slope"))
        )
        sums = sums.withColumnRenamed("source", "of")
        gap = F.col("target") - F.coalesce("given", F.lit(0.0))
        step = F.when(
            (F.col("target") > 0) & (F.abs(gap) > TOLERANCE * F.col("target")),
            F.when(F.col("slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))).otherwise(
                F.when(gap < 0, -1.0).otherwise(0.0)  # all at the cap
            ),
        ).otherwise(0.0)
        moved = tilts.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", (F.col("tilt") + step).alias("tilt"), step.alias("step")
        )
        moved = write_step(moved, "tilts")
        largest = moved.agg(F.max(F.abs("step"))).first()[0]
        tilts = moved.drop("step")
        if not largest or largest < 1e-12:
            return tilts
    return tilts


def mix(docs: DataFrame, cap: float = 3.0, prior: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, source_size, target, rate, copies, taken.

    ``prior`` is a positive rate that a document has before tilting (1 if none or null).
    ``copies`` is a whole number from 0 to ``cap`` rounded down, and
    ``taken = copies * size``. A null text has size 0, a null source is a source
    of its own, a null doc_id is a document like any other. Documents without
    words are never taken. The choice depends on ids and sizes alone, so reruns
    agree; of repeated rows with one id any may be the one with the extra copy.
    An empty table gives an empty result.
    """
    return _mixed(docs, cap, prior)[0].select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _keys(rows: DataFrame, salts: int) -> DataFrame:
    """Add ``class``, ``order``, ``salt`` and ``chance`` (above 0, at most 1), which follow from id, size and text_hash.

    None is nullable: a join on them would else test for nulls in the scan, where each test counts a text's words again.
    """
    order = F.xxhash64("doc_id", "size", "text_hash")
    return rows.select(
        "*",
        F.coalesce(F.when(F.col("size") > 0, F.floor(2 * F.log2(F.col("size")))), F.lit(-1)).alias("class"),
        order.alias("order"),
        F.coalesce(F.pmod(order, F.lit(salts)), F.lit(0)).alias("salt"),
        ((F.shiftrightunsigned(order, 11) + 1) / float(1 << 53)).alias("chance"),
    )


def _mixed(docs: DataFrame, cap: float, prior: Column | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The documents with their copies, the table of runs, the exchanges by row and the number of salts."""
    sized = write_step(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.xxhash64("text").alias("text_hash"),
            word_count().alias("size"),
            F.coalesce((F.lit(1.0) if prior is None else prior).cast("double"), F.lit(1.0)).alias("prior"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    salts = max(SALTS, -(-sized.count() // RUN_ROWS))
    tilts = solve_tilts(sized, source_targets(sized, cap), cap).withColumnRenamed("source", "of")
    rated = sized.join(tilts, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", _rate(cap))
    parted = _keys(rated, salts).select(
        "row", "doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "class", "order", "salt", "chance",
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("part"),
    )
    # the number of extra copies: a running sum of fractions over a source, large documents first
    runs = parted.groupBy("source", "class", "salt").agg(F.sum("part").alias("parts"), F.max("rate").alias("run_rate"))
    before = W.partitionBy("source").orderBy(F.col("class").desc(), "salt").rowsBetween(W.unboundedPreceding, -1)
    half = F.coalesce(F.sum("parts").over(before), F.lit(0.0)) + 0.5
    runs = runs.select(
        F.col("source").alias("of"), F.col("class").alias("of_class"), F.col("salt").alias("of_salt"), "run_rate",
        (F.floor(half + F.col("parts")) - F.floor(half)).alias("extra"),
    )
    within = W.partitionBy("source", "class", "salt").orderBy(F.try_divide("chance", "part").asc_nulls_last(), "order", "row")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("salt") == F.col("of_salt"))
    placed = parted.withColumn("place", F.row_number().over(within)).join(runs, same)
    copies = F.floor("rate") + ((F.col("place") <= F.col("extra")) & (F.col("part") > 0)).cast("long")
    rounded = write_step(
        placed.withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.lit(int(cap)))).otherwise(0).cast("long")).select(
            "row", "doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "class", "order", "salt", "chance",
            "place", "extra", "copies",
        ),
        "rounded",
    )
    swaps = write_step(_closing(rounded, int(cap)), "swaps")
    changed = rounded.join(swaps, "row", "left").withColumn(
        "copies", F.col("copies") + F.coalesce("change", F.lit(0).cast("long"))
    )
    last = F.max(F.when(F.col("place") <= F.col("extra"), F.struct("chance", "order"))).alias("last")
    thresholds = rounded.where("size > 0").groupBy("source", "class", "salt").agg(F.max("rate").alias("run_rate"), last)
    return changed, thresholds, swaps, salts


def _closing(rounded: DataFrame, cap: int) -> DataFrame:
    """``(row, change)``: single copies to add or give back so that sources meet their targets.

    A few documents per source and size class stand for the rest (at most 8 of about
    60 classes), and each source takes them in falling size while they fit its gap.
    """
    gaps = rounded.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")
    ).select(F.col("source").alias("of"), "gap")
    able = rounded.join(gaps, F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("size") > 0)
        & (F.col("size") <= F.abs("gap"))
        & F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    )
    kept = able.groupBy("source", "gap", "class", F.pmod("order", F.lit(8)).alias("eighth")).agg(
        F.min(F.struct("order", "size", "row")).alias("one")
    )
    lists = kept.groupBy("source", "gap").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("one.size").alias("size"), F.col("one.order").alias("order"), F.col("one.row").alias("row"))), asc=False
        ).alias("offers")
    )
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    picked = F.aggregate(
        "offers",
        start,
        lambda acc, x: F.when(
            x["size"] <= acc["left"],
            F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["rows"], F.array(x["row"])).alias("rows")),
        ).otherwise(acc),
    )
    return lists.select(
        F.explode(picked["rows"]).alias("row"), F.when(F.col("gap") > 0, 1).otherwise(-1).cast("long").alias("change")
    )


def _bounded(df: DataFrame) -> DataFrame:
    """Written and, if its counted rows allow it, broadcast."""
    written = write_step(df, "bounded")
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def apply_mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A scan of ``docs`` decides for itself: a document has the copies of its run, and one more if its
    hash is not above the last that the run gave an extra copy. Rows of the exchange and rows that repeat id, text and source are looked
    up. Of the latter one stands for all, with the copies of all.
    """
    names = docs.columns
    mixed, runs, swaps, salts = _mixed(docs, cap, None)
    key = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source")]
    repeated = (
        mixed.groupBy(*key).agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows")).where("__rows > 1").drop("__rows")
    )
    repeated = _bounded(repeated)
    changes = _bounded(mixed.join(swaps.select("row"), "row").select(*key, F.col("change").alias("__change")))
    runs = _bounded(runs.select(*[F.col(c).alias(f"__{c}") for c in runs.columns]))

    keyed = docs.select(
        F.struct(*names).alias("__doc"), "doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count().alias("size")
    )
    keyed = _keys(keyed, salts)  # rows without words have no run
    of_run = keyed["source"].eqNullSafe(runs["__source"]) & (keyed["class"] == runs["__class"]) & (keyed["salt"] == runs["__salt"])

    def matched(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(other["__id"]) & rows["source"].eqNullSafe(other["__source"])
        return rows.join(other, same & (rows["text_hash"] == other["__hash"]), how)

    extra = F.coalesce(F.struct("chance", "order") <= F.col("__last"), F.lit(False)) & (F.col("__run_rate") > F.floor("__run_rate"))
    copies = F.least(F.floor("__run_rate") + extra.cast("long"), F.lit(int(cap)))
    single = keyed.join(runs, of_run).withColumn("copies", copies).drop("__source")
    single = matched(matched(single, changes, "left"), repeated, "left_anti")
    single = single.select("__doc", (F.col("copies") + F.coalesce("__change", F.lit(0).cast("long"))).alias("copies"))
    if not repeated.isEmpty():
        group = ["__id", "__hash", "__source"]
        again = matched(keyed, repeated, "inner").dropDuplicates(group)
        single = single.unionByName(again.select("__doc", F.col("__sum").alias("copies")))
    rows = single.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("__doc")[n].alias(n) for n in names])
