"""Benchmark items inside documents, found by size-partitioned MinHash containment.

A short item shares next to nothing with a long document taken whole. Items
are therefore put into size classes, and for each class a document is read
in windows of about that size: an item that lies in the document fills a good part of
some window, so that MinHash coordinates of the two agree often. Every pair that agrees
in one coordinate is checked by exact containment of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecspark.llm.support import ship_package, small, write_step
from vecspark.llm.textscan import U64, Words, groups, mix

WIDTH = 5
CONTAINMENT = 0.8
#: A window holds at least 0.25 of its content from a found item, so 64 coordinates miss one in 10^8.
COORDINATES = 64
#: The smallest class has items of one or two shingles, read in windows of three.
SMALLEST = 2
#: Items are searched in blocks of at most so many shingles (8 bytes each, and as many again for the coordinates).
BLOCK_SHINGLES = 500_000

_seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_factors = (_seeds[:COORDINATES] >> U64(32)).astype(np.uint32) | np.uint32(1)
_shifts = (_seeds[COORDINATES:] >> U64(32)).astype(np.uint32)

MATCHES = "doc_id long, item_id long, n_shared int, n_item int, containment double"


def halves(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(32)).astype(np.uint32)


def coordinate(half: np.ndarray, k: int) -> np.ndarray:
    """The k-th coordinate's order of shingles, given by half their hash, as 32-bit values."""
    return (half ^ _shifts[k]) * _factors[k]


@dataclass(frozen=True)
class ItemIndex:
    """Shingle sets of a block of items; for each size class the items by coordinate value."""

    ids: list
    sets: list[np.ndarray]
    classes: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # size bound: per coordinate sorted values, items


def size_class(n: int) -> int:
    bound = SMALLEST
    while bound < n:
        bound *= 2
    return bound


def index_items(items: list[tuple[object, np.ndarray]]) -> ItemIndex:
    classes: dict[int, list[int]] = {}
    for i, (_, shingles) in enumerate(items):
        classes.setdefault(size_class(len(shingles)), []).append(i)
    tables, upper = {}, [halves(s) for _, s in items]
    for bound, members in classes.items():
        tables[bound] = []
        for k in range(COORDINATES):
            values = np.array([coordinate(upper[i], k).min() for i in members], np.uint32)
            order = np.argsort(values, kind="stable")
            tables[bound].append((values[order], np.array(members)[order]))
    return ItemIndex([i for i, _ in items], [s for _, s in items], tables)


def search(words: Words, index: ItemIndex, threshold: float) -> list[tuple[int, int, int]]:
    """``(text, item, shared shingles)`` of texts that hold at least ``threshold`` of an item's shingles."""
    shingles, bounds = words.shingles(WIDTH)
    if not len(shingles):
        return []
    counts = np.diff(bounds)
    texts = np.flatnonzero(counts)
    smallest = min(index.classes) // 2
    # chunks of half the smallest bound, cut anew in each text; larger classes join pairs of chunks
    n_chunks = -(-counts[texts] // smallest)
    chunk_text = np.repeat(texts, n_chunks)
    within = np.arange(len(chunk_text)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    cuts = bounds[chunk_text] + within * smallest
    found: set[tuple[int, int]] = set()
    upper = halves(shingles)
    for k in range(COORDINATES):
        minima, owner, place, size = np.minimum.reduceat(coordinate(upper, k), cuts), chunk_text, within, smallest
        for bound in sorted(index.classes):
            while size < bound // 2:
                even = place % 2 == 0
                joined = minima[even]
                mate = np.flatnonzero(even) + 1
                has = (mate < len(minima)) & ~even[np.minimum(mate, len(minima) - 1)]
                joined[has] = np.minimum(joined[has], minima[mate[has]])
                minima, owner, place, size = joined, owner[even], place[even] // 2, 2 * size
            # a window is three chunks: any run of ``bound`` shingles lies in one
            windows = minima.copy()
            for step in (1, 2):
                same = owner[step:] == owner[:-step]
                ahead = windows[:-step]
                np.minimum(ahead, np.where(same, minima[step:], np.uint32(0xFFFFFFFF)), out=ahead)
            values, members = index.classes[bound][k]
            marks = np.zeros(1 << 16, bool)
            marks[values & np.uint32(0xFFFF)] = True
            for w in np.flatnonzero(marks[windows & np.uint32(0xFFFF)]):
                a, b = np.searchsorted(values, windows[w], "left"), np.searchsorted(values, windows[w], "right")
                for m in members[a:b]:
                    found.add((int(owner[w]), int(m)))
    out, text, own = [], -1, None
    for t, m in sorted(found):
        if t != text:
            text, own = t, np.unique(shingles[bounds[t] : bounds[t + 1]])
        at = np.minimum(np.searchsorted(own, index.sets[m]), len(own) - 1)
        shared = int((own[at] == index.sets[m]).sum())
        if shared >= threshold * len(index.sets[m]) - 1e-9:
            out.append((t, m, shared))
    return out


def _item_sets(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in groups(batch):
                shingles, bounds = Words(raw, offsets, True).shingles(WIDTH)
                sets = [np.unique(shingles[bounds[i] : bounds[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["item_id", "n", "shingles"],
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, n int, shingles binary").where("n > 0")


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)``: documents that hold at least ``threshold`` of an item's shingles.

    Shingles are five consecutive words, A-Z in lower case. A text with fewer words, but one at
    least, is a single shingle of all its words, so such an item is found in documents that consist of it.
    Null and empty texts, of items or documents, match nothing. A repeated row gives
    its matches again. With no items or no documents the result is empty.
    Items are read in blocks of a bounded size, each sent to all tasks; all documents are searched for each block.
    """
    ship_package(docs.sparkSession)
    items = _item_sets(benchmark)
    blocks, block, size = [], [], 0
    for row in items.toLocalIterator():
        if block and size + row["n"] > BLOCK_SHINGLES:
            blocks.append(block)
            block, size = [], 0
        block.append((row["item_id"], np.frombuffer(row["shingles"], U64)))
        size += row["n"]
    blocks.append(block)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in blocks:
        part = _search_block(narrow, index_items(block), threshold) if block else narrow.sparkSession.createDataFrame([], MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(docs: DataFrame, index: ItemIndex, threshold: float) -> DataFrame:
    shared_index = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared_index.value
        for batch in batches:
            for part, raw, offsets in groups(batch, limit=1 << 20):
                hits = search(Words(raw, offsets, True), index, threshold)
                ids = part.column(0).to_pylist()
                n = [len(index.sets[m]) for _, m, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[t] for t, _, _ in hits], pa.int64()),
                        pa.array([index.ids[m] for _, m, _ in hits], pa.int64()),
                        pa.array([s for _, _, s in hits], pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array([s / x for (_, _, s), x in zip(hits, n)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

    return docs.mapInArrow(run, MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows without doc_id are kept only if their text is clean too."""
    index = find_contamination(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, threshold)
    bad = write_step(index.select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.join(small(bad), F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__key"), "left_anti")
