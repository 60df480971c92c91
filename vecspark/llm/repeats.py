"""Exact repeats of word sequences, found by fixed-block anchors.

Every repeat of ``2 * block`` words holds a whole block of the fixed grid of its earlier
text. The grid's blocks are indexed by hash and probed with every rolling window of a block's
length; windows that hit lead to the maximal repeats around them. Of every
``window``-word sequence inside a repeat the first place is kept, all later ones are removed.

Hashes travel as arrays: a pack of documents sends each hash bucket one row, and
a bucket answers each pack with one row. A sequence that recurs within a pack is
settled there and sent once, so frequent passages do not pile up in a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecspark.llm.support import ship_package, small, write_step
from vecspark.llm.textscan import U64, Words, groups

WINDOW = 20
#: Texts behind a hash bucket have about so many characters together; a bucket is matched in one task.
BUCKET_CHARS = 8 << 20
PACK_BYTES = 6 << 20
NO_ID = np.iinfo(np.int64).max

#: Kinds of rows: hashes for a bucket (or, as its answer, places); the pack's own facts.
PROBE, FACTS = 0, 1
SENT = "bucket int, pack long, kind int, payload binary"
ANSWERED = "pack long, kind int, payload binary"


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays of any fixed types, each with its length in bytes before it."""
    parts = []
    for x in arrays:
        data = np.ascontiguousarray(x).tobytes()
        parts += [len(data).to_bytes(8, "little"), data]
    return b"".join(parts)


def _arrays(data: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in types:
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def _gaps(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as 16-bit gaps; gaps too wide for that apart."""
    gaps = np.diff(places, prepend=0)
    wide = gaps >= 0xFFFF
    return np.where(wide, 0xFFFF, gaps).astype("<u2"), gaps[wide].astype("<i8")


def _places(short: np.ndarray, wide: np.ndarray) -> np.ndarray:
    gaps = short.astype(np.int64)
    gaps[gaps == 0xFFFF] = wide
    return np.cumsum(gaps)


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "pack": pa.int64(), "kind": pa.int32(), "payload": pa.binary(), "key": pa.int64()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns)], names)


def _send(pack: int, hashes: np.ndarray, places: np.ndarray, buckets: int, payload: Callable[[np.ndarray], bytes]) -> list[tuple]:
    """A row for each bucket that gets some of the hashes; ``payload`` makes its message from their indexes."""
    bucket = ((hashes >> U64(40)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((places, bucket))
    begins = _first_of_runs(bucket[order])
    return [
        (int(bucket[order[a]]), pack, PROBE, payload(order[a:b])) for a, b in zip(begins, np.r_[begins[1:], len(order)])
    ]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Words]]:
    from pyspark import TaskContext

    pack = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, raw, offsets in groups(batch, limit=PACK_BYTES):
            yield pack, part, Words(raw, offsets, False)
            pack += 1


def _anchor_probes(block: int, window: int, buckets: int):
    """Every rolling block of every text, those on the text's fixed grid marked as indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, part, words in _packs(batches):
            counts = np.diff(words.first)
            hashes = words.runs(block)
            text = np.repeat(np.arange(len(counts)), counts)[: len(hashes)]
            start = np.arange(len(hashes)) - words.first[text]
            places = np.flatnonzero((start + block <= counts[text]) & (counts[text] >= window))
            hashes, grid = hashes[places], start[places] % block == 0
            order = np.argsort(hashes, kind="stable")
            begins = _first_of_runs(hashes[order])
            sizes = np.diff(np.r_[begins, len(order)])
            lead = order[begins]
            indexed = np.logical_or.reduceat(grid[order], begins) if len(begins) else grid
            settled = places[lead[indexed & (sizes > 1)]]
            later = np.ones(len(order), bool)
            later[begins] = False
            followers, leaders = places[order[later]], places[np.repeat(lead, sizes)[later]]

            def payload(own: np.ndarray) -> bytes:
                low = (hashes[lead[own]] & U64(0xFFFFFFFF)).astype("<u4")
                return _bytes(low, *_gaps(places[lead[own]]), np.packbits(indexed[own]))

            rows = _send(pack, hashes[lead], places[lead], buckets, payload)
            facts = _bytes(part.column(0).to_numpy(zero_copy_only=False), words.first[:-1], settled, followers, leaders)
            yield _rows(["bucket", "pack", "kind", "payload"], [*rows, (buckets + pack % buckets, pack, FACTS, facts)])

    return run


def _by_pack(table: pa.Table, match: Callable[[list[bytes]], list[np.ndarray]]) -> pa.Table:
    """Answer the messages of a bucket, each with the places ``match`` gives for it; facts pass through."""
    kinds = table["kind"].to_numpy()
    probes, facts = table.filter(pa.array(kinds == PROBE)), table.filter(pa.array(kinds != PROBE)).select(["pack", "kind", "payload"])
    answers = match(probes["payload"].to_pylist()) if probes.num_rows else []
    rows = [(p, PROBE, _bytes(x.astype("<i8"))) for p, x in zip(probes["pack"].to_pylist(), answers) if len(x)]
    return pa.concat_tables([facts.cast(pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])), pa.Table.from_batches([_rows(["pack", "kind", "payload"], rows)])])


def _match_anchors(table: pa.Table) -> pa.Table:
    """Hashes with an indexed block in one pack and any window in another."""

    def match(messages: list[bytes]) -> list[np.ndarray]:
        hashes, places, flags = [], [], []
        for m in messages:
            h, short, wide, bits = _arrays(m, "<u4", "<u2", "<i8", "u1")
            hashes.append(h), places.append(_places(short, wide)), flags.append(np.unpackbits(bits)[: len(h)].astype(bool))
        sizes = [len(h) for h in hashes]
        hashes, flags = np.concatenate(hashes), np.concatenate(flags)
        order = np.argsort(hashes, kind="stable")
        begins = _first_of_runs(hashes[order])
        count = np.diff(np.r_[begins, len(order)])
        live = (count > 1) & np.logical_or.reduceat(flags[order], begins)
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(live, count)
        return [p[x] for p, x in zip(places, np.split(hit, np.cumsum(sizes)[:-1]))]

    return _by_pack(table, match)


def _by_text(key: np.ndarray, first: np.ndarray, places: np.ndarray) -> pa.Table:
    """``(key, payload)``: for each text of a pack its places, counted from its first word."""
    places = np.unique(places)
    text = np.searchsorted(first, places, side="right") - 1
    begins = _first_of_runs(text)
    ends = np.r_[begins[1:], len(text)]
    rows = [(int(key[text[a]]), (places[a:b] - first[text[a]]).astype("<i4").tobytes()) for a, b in zip(begins, ends)]
    return pa.Table.from_batches([_rows(["key", "payload"], rows)])


def _facts_and_answers(table: pa.Table) -> tuple[bytes, np.ndarray]:
    kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
    answers = [_arrays(x, "<i8")[0] for k, x in zip(kinds, payloads) if k == PROBE]
    return next(x for k, x in zip(kinds, payloads) if k == FACTS), np.concatenate(answers) if answers else np.zeros(0, np.int64)


def _anchored_texts(table: pa.Table) -> pa.Table:
    facts, live = _facts_and_answers(table)
    key, first, settled, followers, leaders = _arrays(facts, *["<i8"] * 5)
    live = np.union1d(live, settled)
    return _by_text(key, first, np.r_[live, followers[np.isin(leaders, live)]])


def _window_probes(block: int, window: int, buckets: int):
    """The windows around anchors, each sequence once for a pack: at its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, part, words in _packs(batches):
            counts = np.diff(words.first)
            near = np.zeros(len(words.hashes) + 1, np.int32)
            for t, data in enumerate(part.column(3)):
                anchors = np.frombuffer(data.as_py(), "<i4").astype(np.int64)
                last = counts[t] - window
                np.add.at(near, words.first[t] + np.clip(anchors - (window - block), 0, last + 1), 1)
                np.add.at(near, words.first[t] + np.clip(anchors + 1, 0, last + 1), -1)
            places = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            hashes = words.runs(window)[places]
            text = np.searchsorted(words.first, places, side="right") - 1
            start = places - words.first[text]
            ids = part.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, ids[text], hashes))
            begins = _first_of_runs(hashes[order])
            lead = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
            as_first = (ids[text[order]] == ids[text[lead]]) & (start[order] == start[lead])
            sent = np.sort(order[as_first])

            def payload(own: np.ndarray) -> bytes:
                own = sent[own]
                begin = _first_of_runs(text[own])
                return _bytes(hashes[own], *_gaps(places[own]), begin.astype("<u4"), ids[text[own[begin]]], words.first[text[own[begin]]])

            rows = _send(pack, hashes[sent], places[sent], buckets, payload)
            facts = _bytes(part.column(0).to_numpy(zero_copy_only=False), words.first[:-1], places[order[~as_first]])
            yield _rows(["bucket", "pack", "kind", "payload"], [*rows, (buckets + pack % buckets, pack, FACTS, facts)])

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """Windows whose sequence starts earlier in another pack."""

    def match(messages: list[bytes]) -> list[np.ndarray]:
        hashes, places, ids, starts = [], [], [], []
        for m in messages:
            h, short, wide, begin, own, first = _arrays(m, "<u8", "<u2", "<i8", "<u4", "<i8", "<i8")
            repeat = np.diff(np.r_[begin, len(h)])
            place = _places(short, wide)
            hashes.append(h), places.append(place), ids.append(np.repeat(own, repeat)), starts.append(place - np.repeat(first, repeat))
        sizes = [len(h) for h in hashes]
        hashes, ids, starts = np.concatenate(hashes), np.concatenate(ids), np.concatenate(starts)
        order = np.lexsort((starts, ids, hashes))
        begins = _first_of_runs(hashes[order])
        lead = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
        hit = np.zeros(len(order), bool)
        hit[order] = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
        return [p[x] for p, x in zip(places, np.split(hit, np.cumsum(sizes)[:-1]))]

    return _by_pack(table, match)


def _repeated_texts(table: pa.Table) -> pa.Table:
    facts, found = _facts_and_answers(table)
    key, first, settled = _arrays(facts, *["<i8"] * 3)
    return _by_text(key, first, np.r_[found, settled])


def kept_words(text: str | None, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept ones joined by a space."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    gone = np.cumsum(gone[:-1]) > 0
    n = int(gone.sum())
    return len(words), n, b" ".join(words if n == 0 else [w for w, g in zip(words, gone) if not g])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(key, payload)``: for each text the starts of its windows that occur earlier; and the texts concerned.

    ``docs`` has key, doc_id, text. The second table holds the rows of ``docs`` with an anchor.
    """
    ship_package(docs.sparkSession)
    block = window // 2
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET_CHARS))
    probes = docs.select("key", "text").mapInArrow(_anchor_probes(block, window, buckets), SENT)
    answered = probes.groupBy("bucket").applyInArrow(_match_anchors, ANSWERED)
    anchors = write_step(answered.groupBy("pack").applyInArrow(_anchored_texts, "key long, payload binary").dropDuplicates(["key"]), "anchors")
    texts = docs.join(small(anchors.select("key")), "key", "left_semi")
    held = write_step(texts.join(anchors, "key").select("key", "doc_id", "text", "payload"), "held")
    probes = held.mapInArrow(_window_probes(block, window, buckets), SENT)
    answered = probes.groupBy("bucket").applyInArrow(_match_windows, ANSWERED)
    found = answered.groupBy("pack").applyInArrow(_repeated_texts, "key long, payload binary")
    return write_step(found.dropDuplicates(["key"]), "repeats"), held


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``docs (doc_id, text)``.

    Words are runs of characters other than space and ``\\x09``-``\\x0D``, unchanged. A word is removed if a window of
    ``window`` words covers it whose sequence starts earlier too: in a smaller doc_id, or in the same document. ``kept`` is
    the text of the other words, joined by one space, or with ``digest`` its SHA-256 as lowercase hex.
    Null and empty texts have no words. Rows without doc_id come after all others and count as one document with each other;
    rows that repeat an id are one document too, so a window is not held against the same place of
    such a row. An empty table gives no rows.
    """
    docs = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    found, held = repeated_windows(docs, window)

    def outcome(columns: list, text: str | None, starts: bytes) -> tuple:
        n, removed, kept = kept_words(text, np.frombuffer(starts, "<i4").astype(np.int64), window)
        return (*columns, n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode())

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [outcome([k], t, p) for k, t, p in zip(*(c.to_pylist() for c in batch.columns))]
            yield _outcomes("key", rows)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = [outcome([k, d], t, b"") for k, d, t in zip(*(c.to_pylist() for c in batch.columns))]
                yield _outcomes("key", rows, "doc_id")

    kinds = "n_words long, n_removed long, kept string"
    new = held.select("key", "text").dropDuplicates(["key"]).join(found, "key").select("key", "text", "payload")
    new = write_step(new.mapInArrow(changed, f"key long, {kinds}"), "changed")
    new = new.select("key", F.col("n_removed").alias("__removed"), F.col("kept").alias("__kept"))
    every = docs.mapInArrow(untouched, f"key long, doc_id long, {kinds}")
    return every.join(new, "key", "left").select(
        "doc_id", "n_words", F.coalesce("__removed", "n_removed").alias("n_removed"), F.coalesce("__kept", "kept").alias("kept")
    )


def _outcomes(key: str, rows: list[tuple], *more: str) -> pa.RecordBatch:
    names = [key, *more, "n_words", "n_removed", "kept"]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept" else pa.int64()) for n, c in zip(names, columns)], names)
