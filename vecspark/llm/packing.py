"""Token ids of whole documents, packed into fixed-length rows.

Documents are tokenised with a public vocabulary, cut into pieces of at most one
row's length, dealt into shards by hash, and each shard is packed best fit
decreasing: a piece goes to the row with the least room that still takes it.
"""

from __future__ import annotations

import array
import base64
import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vecspark.llm.support import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern of the vocabulary's pieces: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
ROW_TOKENS = 2048
#: Texts of a shard have about so many characters together; a shard is packed in one task.
SHARD_CHARS = 4 << 20

PACKED = (
    "shard long, row int, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, "
    "doc_ids array<long>, piece_starts array<long>"
)


class RoomTree:
    """Segment tree over room sizes: how many open rows have each amount of room."""

    def __init__(self, capacity: int):
        self.size = 1 << int(capacity).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room of at least ``need``, and that room."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (0 if self.count[2 * node] else 1)
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return row, room


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: for each row the pieces in it, longest first."""
    tree, rows = RoomTree(capacity), []
    for piece in np.argsort(-lengths, kind="stable"):
        need = int(lengths[piece])
        found = tree.take(need)
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, room = found
        rows[row].append(int(piece))
        if room > need:
            tree.put(room - need, row)
    return rows


class Encoder:
    """Ids of texts as bytes: 16-bit numbers if the vocabulary fits into them, else 32-bit ones."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.code = "H" if max(ranks.values()) < 0xFFFF else "I"

    def encode(self, text: str, tail: list[int]) -> bytes:
        return array.array(self.code, self.encoding.encode_ordinary(text) + tail).tobytes()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, end: int | None = END_OF_TEXT) -> DataFrame:
    """``(doc_id, text_hash, spread, n_tokens, ids binary)``: ids of each whole text, in the width of ``id_type``.

    ``end`` is appended to every text; null and empty texts have no ids at all. ``spread`` is 0 for a row and
    numbers its further occurrences within a task, so that equal rows need not share a shard. Equal rows
    are interchangeable, so a task that is run again numbers them alike in any order of its rows.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(vocabulary)
        size = array.array(pieces.code).itemsize
        tail = [] if end is None else [end]
        seen: collections.Counter[tuple] = collections.Counter()
        task = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                spread = []
                for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    spread.append(task + seen[key] if seen[key] else 0)
                    seen[key] += 1
                out = [pieces.encode(text, tail) if text else b"" for text in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(spread, pa.int64()),
                        pa.array([len(x) // size for x in out], pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "spread", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, spread long, n_tokens long, ids binary")


def id_type(vocabulary: str) -> str:
    return encoder(vocabulary).code


def pack(tokens: DataFrame, code: str, shards: int, capacity: int = ROW_TOKENS, pad: int = END_OF_TEXT) -> DataFrame:
    """Pack ``tokenize`` output (ids of type ``code``) into rows of ``capacity`` ids.

    Row: shard, row, input_ids (padded to ``capacity``), position_ids (restarting at 0
    in every segment, 0 in the padding), cu_seqlens (segment bounds from 0; the last
    is the number of real ids), doc_ids and piece_starts (for each segment, its
    document and where in the document's ids it begins).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        ids = [np.frombuffer(x.as_py(), code) for x in table["ids"]]
        documents = table["doc_id"].to_pylist()
        pieces = [(d, s) for d, x in enumerate(ids) for s in range(0, len(x), capacity)]
        lengths = np.array([min(capacity, len(ids[d]) - s) for d, s in pieces], np.int64)
        shard = table["shard"][0].as_py()
        rows = pack_lengths(lengths, capacity)
        matrix = np.full((len(rows), capacity), pad, np.int32)
        positions = np.zeros((len(rows), capacity), np.int32)
        bounds, owners, starts = [], [], []
        for r, row in enumerate(rows):
            at, bound = 0, [0]
            for p in row:
                d, s = pieces[p]
                n = int(lengths[p])
                matrix[r, at : at + n] = ids[d][s : s + n]
                positions[r, at : at + n] = np.arange(n)
                at += n
                bound.append(at)
            bounds.append(bound)
            owners.append([documents[pieces[p][0]] for p in row])
            starts.append([pieces[p][1] for p in row])
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * capacity)
        return pa.table(
            {
                "shard": pa.array([shard] * len(rows), pa.int64()),
                "row": pa.array(range(len(rows)), pa.int32()),
                "input_ids": pa.ListArray.from_arrays(ends, pa.array(matrix.ravel())),
                "position_ids": pa.ListArray.from_arrays(ends, pa.array(positions.ravel())),
                "cu_seqlens": pa.array(bounds, pa.list_(pa.int32())),
                "doc_ids": pa.array(owners, pa.list_(pa.int64())),
                "piece_starts": pa.array(starts, pa.list_(pa.int64())),
            }
        )

    shard = F.pmod(F.xxhash64("doc_id", "text_hash", "spread"), F.lit(shards)).alias("shard")
    dealt = tokens.where("n_tokens > 0").select(shard, "doc_id", "text_hash", "ids")
    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = ROW_TOKENS, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """Tokenise and pack all documents; see ``pack`` for the rows.

    A document longer than a row is cut into consecutive pieces, so its ids can be
    put together again from doc_ids and piece_starts. Null and empty texts give no
    segment; a null doc_id stays null in ``doc_ids``; repeated rows are packed each. Other columns
    are ignored. An empty table gives no rows.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return pack(tokenize(docs, vocabulary), id_type(vocabulary), max(1, -(-chars // shard_chars)), capacity)


def as_binary(packed: DataFrame) -> DataFrame:
    """Arrays of ``pack`` as little-endian binary columns, for readers that map bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"input_ids": "<i4", "position_ids": "<i4", "cu_seqlens": "<i4"}
        for batch in batches:
            columns = [batch.column(0), batch.column(1)]
            for name, kind in kinds.items():
                lists = batch.column(batch.schema.get_field_index(name))
                columns.append(pa.array([np.asarray(x.values, kind).tobytes() for x in lists], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["shard", "row", *kinds])

    return packed.mapInArrow(run, "shard long, row int, input_ids binary, position_ids binary, cu_seqlens binary")
