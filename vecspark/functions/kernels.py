"""Numpy helpers that run inside Spark tasks on Arrow batches.

Spark splits the rows and shuffles; these functions only do the arithmetic of
one block of base vectors against one block of query vectors and keep the k
best answers per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

METRICS = ("l1", "l2", "ip", "cosine", "hamming", "jaccard")
BIT_METRICS = ("hamming", "jaccard")

#: elements of one score matrix, and of one gathered block of exact pairs
SCORE_ELEMENTS = 1_000_000
PAIR_ELEMENTS = 8_000_000
TILE_ROWS = 1024
#: queries from which cells are formed, and the share of pairs left from which they save nothing
CELL_QUERIES = 256
PRUNED_SHARE = 0.5

RESULT_FIELDS = "qid long, id long, distance double"
_RESULT_SCHEMA = pa.schema(
    [("qid", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]
)


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return metric


def as_matrix(column) -> np.ndarray:
    """``[rows, dim]`` view of a list column; every row must have the same size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors differ in dimension: {sizes.min()} and {sizes.max()}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null element in a vector")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]))


def as_list_array(matrix: np.ndarray) -> pa.ListArray:
    rows, dim = matrix.shape
    offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def exact_type(metric: str):
    return np.int64 if metric in BIT_METRICS else np.float64


def set_bits(words: np.ndarray) -> np.ndarray:
    """Bits set in each word, the sign bit included (numpy would count those of the absolute value)."""
    return np.bitwise_count(words.astype(np.int64, copy=False).view(np.uint64))


def paired(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the matching row of ``b`` (or to one vector)."""
    if metric == "l1":
        return np.abs(a - b).sum(axis=-1)
    if metric == "l2":
        return np.sqrt(np.square(a - b).sum(axis=-1))
    if metric == "ip":
        return 0.0 - (a * b).sum(axis=-1)
    if metric == "cosine":
        norms = np.sqrt(np.square(a).sum(axis=-1)) * np.sqrt(np.square(b).sum(axis=-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (a * b).sum(axis=-1) / norms
        return np.where(norms == 0, np.nan, np.maximum(1.0 - cosine, 0.0))
    if metric == "hamming":
        return set_bits(a ^ b).sum(axis=-1).astype(np.float64)
    if metric == "jaccard":
        both = set_bits(a & b).sum(axis=-1).astype(np.float64)
        either = set_bits(a | b).sum(axis=-1).astype(np.float64)
        return np.where(either == 0, 0.0, 1.0 - both / np.maximum(either, 1.0))
    raise ValueError(f"unknown metric {metric!r}")


class QueryBlock:
    """Query vectors of one block, with what the screening product needs."""

    def __init__(self, metric: str, qids: np.ndarray, matrix: np.ndarray):
        self.metric = check_metric(metric)
        self.qids = qids
        self.exact = np.ascontiguousarray(matrix, dtype=exact_type(metric))
        self._screens: dict = {}
        if metric not in BIT_METRICS:
            with np.errstate(over="ignore", invalid="ignore"):
                self.norms = np.sqrt(np.square(self.exact).sum(axis=1))

    def screen(self, dtype) -> np.ndarray:
        key = np.dtype(dtype)
        if key not in self._screens:
            rows = -self.exact
            if self.metric == "cosine":
                rows = rows / np.where(self.norms == 0, 1.0, self.norms)[:, None]
            elif self.metric == "l2":  # |b|^2 - 2 q.b, when b carries |b|^2 as one more coordinate
                rows = np.column_stack([2 * rows, np.ones(len(rows))])
            self._screens[key] = rows.astype(key)
        return self._screens[key]

    def bits(self, width: int) -> np.ndarray:
        if width not in self._screens:
            self._screens[width] = unpack_bits(self.exact, width)
        return self._screens[width]


class TopK:
    """The k best (distance, id) per query seen so far; NaN distances sort last."""

    def __init__(self, queries: int, k: int, bound: np.ndarray | None = None):
        self.k = k
        self.limit = np.full(queries, np.inf) if bound is None else np.array(bound, dtype=np.float64)
        self._parts: list = []
        self._fresh = 0
        self._kept = 0

    def offer(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        limit = self.limit[q]
        keep = (d <= limit) | (np.isnan(d) & np.isinf(limit))
        if keep.any():
            self._parts.append((q[keep], ids[keep], d[keep]))
            self._fresh += int(keep.sum())

    def settle(self, force: bool = False) -> None:
        """Drop what can no longer be among the k best and tighten the limits."""
        if not self._fresh or not (force or self._fresh > max(self._kept // 2, 10_000)):
            return
        q, ids, d = (np.concatenate(c) for c in zip(*self._parts))
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = (rank == self.k - 1) & ~np.isnan(d)
        self.limit[q[last]] = np.minimum(self.limit[q[last]], d[last])
        keep = rank < self.k
        self._parts = [(q[keep], ids[keep], d[keep])]
        self._kept, self._fresh = int(keep.sum()), 0

    def result(self):
        self.settle(force=True)
        if not self._parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return self._parts[0]


def scan_block(best: TopK, queries: QueryBlock, rows: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
    """Offer every vector of ``block`` to the queries numbered ``rows``."""
    if not len(rows) or not len(ids):
        return
    if block.shape[1] != queries.exact.shape[1]:
        raise ValueError(f"vectors differ in dimension: {block.shape[1]} and {queries.exact.shape[1]}")
    metric = queries.metric
    if metric in BIT_METRICS:
        full = block.astype(np.int64, copy=False)
        width = max(used_width(queries.exact), used_width(full))
        bits = unpack_bits(full, width)
        step = max(1, SCORE_ELEMENTS // len(ids))
        for lo in range(0, len(rows), step):
            r = rows[lo:lo + step]
            scores = bit_scores(metric, queries.bits(width)[r], bits)
            _offer_within(best, queries, r, ids, full, scores, best.limit[r], np.zeros(len(r)))
        return

    full = block.astype(np.float64, copy=False)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(np.square(full).sum(axis=1))
    # Norms that are NaN or infinite bound nothing: such rows and queries are
    # measured exactly against everything, the rest is screened among itself.
    tame, calm = np.isfinite(norms), np.isfinite(queries.norms[rows])
    if not (tame.all() and calm.all()):
        _offer_all(best, queries, rows, ids[~tame], full[~tame])
        _offer_all(best, queries, rows[~calm], ids[tame], full[tame])
        rows, ids, block, full, norms = rows[calm], ids[tame], block[tame], full[tame], norms[tame]
        if not len(rows) or not len(ids):
            return
    top, widest = norms.max(), queries.norms[rows].max()
    small = block.dtype == np.float32 and top < 1e15 and widest < 1e15
    dtype = np.float32 if small else np.float64
    screened = block.astype(dtype, copy=False)
    if metric == "cosine":
        screened = (full / np.where(norms == 0, 1.0, norms)[:, None]).astype(dtype)
    elif metric == "l2":
        screened = np.column_stack([screened, np.square(norms).astype(dtype)])
    elif metric == "l1":
        reach = np.abs(full).sum(axis=1).max()
    # A product of two dim-long vectors is off by at most dim rounding units of
    # |a||b|, so a row within the limit plus this slack cannot be missed.
    unit = (block.shape[1] + 16) * np.finfo(dtype).eps
    step = max(1, SCORE_ELEMENTS // len(ids))
    for lo in range(0, len(rows), step):
        r = rows[lo:lo + step]
        limit = best.limit[r]
        if metric == "l1":
            scores = l1_scores(queries.screen(dtype)[r], screened)
            slack = 4 * unit * (np.abs(queries.exact[r]).sum(axis=1) + reach)
            _offer_within(best, queries, r, ids, full, scores, limit + slack, slack)
            continue
        scores = queries.screen(dtype)[r] @ screened.T
        if metric == "l2":
            slack = 4 * unit * np.square(queries.norms[r] + top)
            limit = np.square(limit) - np.square(queries.norms[r]) + slack
        elif metric == "ip":
            slack = 2 * unit * queries.norms[r] * top + np.finfo(dtype).tiny
            limit = limit + slack
        else:
            scores[:, norms == 0] = np.inf
            scores[queries.norms[r] == 0] = np.inf
            slack = np.full(len(r), 4 * unit)
            limit = limit - 1.0 + slack
        _offer_within(best, queries, r, ids, full, scores, limit, slack)


def _offer_all(best: TopK, queries: QueryBlock, rows: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
    """Offer every pair with its exact distance."""
    step = max(1, PAIR_ELEMENTS // max(1, full.shape[1]))
    for at in range(0, len(rows) * len(ids), step):
        q_at, b_at = np.divmod(np.arange(at, min(at + step, len(rows) * len(ids))), len(ids))
        with np.errstate(over="ignore", invalid="ignore"):
            best.offer(rows[q_at], ids[b_at], paired(queries.metric, queries.exact[rows[q_at]], full[b_at]))
        best.settle()


def _offer_within(best: TopK, queries: QueryBlock, r, ids, full, scores, limit, slack) -> None:
    """Offer the rows whose score is within ``limit``, with their exact distance."""
    open_rows = np.flatnonzero(np.isinf(limit))
    if len(open_rows) and len(ids) > best.k:
        kth = np.partition(scores[open_rows], best.k - 1, axis=1)[:, best.k - 1]
        limit[open_rows] = kth + 2 * slack[open_rows]
    q_at, b_at = np.divmod(np.flatnonzero(scores <= limit.astype(scores.dtype)[:, None]), len(ids))
    pairs = max(1, PAIR_ELEMENTS // full.shape[1])
    for at in range(0, len(q_at), pairs):
        q, b = r[q_at[at:at + pairs]], b_at[at:at + pairs]
        best.offer(q, ids[b], paired(queries.metric, queries.exact[q], full[b]))
        best.settle()


def l1_scores(negated: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Manhattan distances, one coordinate at a time over tiles that stay in cache."""
    scores = np.empty((len(negated), len(block)), dtype=block.dtype)
    for lo in range(0, len(block), TILE_ROWS):
        columns = np.ascontiguousarray(block[lo:lo + TILE_ROWS].T)
        total = np.zeros((len(negated), columns.shape[1]), dtype=block.dtype)
        part = np.empty_like(total)
        for j, column in enumerate(columns):
            np.add(negated[:, j, None], column, out=part)
            np.abs(part, out=part)
            total += part
        scores[:, lo:lo + TILE_ROWS] = total
    return scores


def bit_scores(metric: str, queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Hamming or Jaccard distances of rows of 0/1; the counts are exact in float32."""
    both = (queries @ block.T).astype(np.float64)
    total = queries.sum(axis=1, dtype=np.float64)[:, None] + block.sum(axis=1, dtype=np.float64)
    if metric == "hamming":
        return total - 2 * both
    either = total - both
    return np.where(either == 0, 0.0, 1.0 - both / np.maximum(either, 1.0))


def word_distances(metric: str, points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Hamming or Jaccard distances of packed words, each row against each centroid."""
    both = np.zeros((len(points), len(centroids)), np.int32)
    for w in range(points.shape[1]):
        both += set_bits(points[:, w, None] & centroids[None, :, w])
    total = set_bits(points).sum(axis=1, dtype=np.int32)[:, None] + set_bits(centroids).sum(axis=1, dtype=np.int32)
    if metric == "hamming":
        return total - 2 * both
    either = total - both
    return np.where(either == 0, 0.0, 1.0 - both / np.maximum(either, 1))


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0/1 from words of which the lowest ``width`` bits are used."""
    narrow = np.ascontiguousarray(words, dtype=np.int64).astype(f"<u{width // 8}")
    return np.unpackbits(narrow.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def used_width(words: np.ndarray) -> int:
    return 32 if words.min() >= 0 and words.max() < 1 << 32 else 64


def result_batches(queries: QueryBlock, best: TopK, rows: int = 200_000):
    q, ids, d = best.result()
    for lo in range(0, len(q), rows):
        part = slice(lo, lo + rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.qids[q[part]]), pa.array(ids[part]), pa.array(d[part])],
            schema=_RESULT_SCHEMA,
        )


class QueryCells:
    """Queries grouped round some of them, with the radius of each group in the space of cells.

    A vector at distance D of a centre is at least D - radius from every query of the cell, so it
    cannot be among their k best where that exceeds the largest of their limits.
    """

    def __init__(self, metric: str, centres: np.ndarray, members: list[np.ndarray], radii: np.ndarray):
        self.metric, self.centres, self.members, self.radii = metric, centres, members, radii
        self.squares = np.square(centres).sum(axis=1)

    def reach(self, limits: np.ndarray) -> np.ndarray:
        """Per cell the largest limit of its queries, as a distance in the space of cells."""
        widest = np.array([limits[m].max() for m in self.members])
        if self.metric == "l2":
            return widest
        # a cosine distance is off by some rounding units, whose root counts here
        return np.sqrt(2 * (widest + (4 * self.centres.shape[1] + 64) * np.finfo(np.float64).eps))

    def near(self, block: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """``[rows, cells]``: may the vector be among the k best of a query of the cell?"""
        with np.errstate(all="ignore"):
            points = cell_space(self.metric, block)
            squares = np.square(points).sum(axis=1)
            square = squares[:, None] + self.squares - 2 * (points @ self.centres.T)
            # the product is off by dim rounding units of the squared lengths at most
            slack = (4 * points.shape[1] + 64) * np.finfo(np.float64).eps * (squares[:, None] + self.squares)
            least = np.sqrt(np.maximum(square - slack, 0.0))
            out = least > (self.radii + self.reach(limits)) * (1 + 1e-9)
        return ~out  # what is not a number is not out


def query_cells(metric: str, matrix: np.ndarray) -> QueryCells | None:
    """Cells for a block of queries, or None where they cannot help."""
    if metric not in ("l2", "cosine") or len(matrix) < CELL_QUERIES or not np.isfinite(matrix).all():
        return None
    points = cell_space(metric, matrix)
    if not np.isfinite(np.square(points).sum(axis=1)).all():
        return None
    count = int(np.sqrt(len(points)))
    chosen = np.sort(np.random.default_rng(5).choice(len(points), count, replace=False))
    centres, half = points[chosen], np.square(points[chosen]).sum(axis=1) / 2
    nearest = np.empty(len(points), np.int64)
    step = max(1, SCORE_ELEMENTS // count)
    for lo in range(0, len(points), step):
        nearest[lo:lo + step] = (half - points[lo:lo + step] @ centres.T).argmin(axis=1)
    kept = np.unique(nearest)
    members = [np.flatnonzero(nearest == c) for c in kept]
    radii = [np.sqrt(np.square(points[m] - centres[c]).sum(axis=1)).max() for m, c in zip(members, kept)]
    return QueryCells(metric, centres[kept], members, np.array(radii) * (1 + 1e-9))


def scan_cells(best: TopK, queries: QueryBlock, cells: QueryCells, ids: np.ndarray, block: np.ndarray) -> None:
    """As ``scan_block`` for all queries, but a cell meets only the vectors in its reach."""
    near = cells.near(block, best.limit)
    sizes = np.array([len(m) for m in cells.members])
    if (near.sum(axis=0) * sizes).sum() > PRUNED_SHARE * len(ids) * sizes.sum():
        scan_block(best, queries, np.arange(sizes.sum()), ids, block)
        return
    for c in np.flatnonzero(near.any(axis=0)):
        rows = np.flatnonzero(near[:, c])
        scan_block(best, queries, cells.members[c], ids[rows], block[rows])


def topk_scan(shared, k: int, metric: str):
    """``mapInArrow`` body: scan ``(id, v)`` batches against broadcast queries."""

    def run(batches):
        yield from _scanned(batches, *shared.value, k, metric)

    return run


def topk_scan_blocks(shared: list, k: int, metric: str):
    """As ``topk_scan``, for queries that come in several broadcasts; their cells are formed in the task."""

    def run(batches):
        qids, matrix, bounds = zip(*(block.value for block in shared))
        qids, matrix = np.concatenate(qids), np.concatenate(matrix)
        bound = None if bounds[0] is None else np.concatenate(bounds)
        yield from _scanned(batches, qids, matrix, bound, query_cells(metric, matrix), k, metric)

    return run


def _scanned(batches, qids, matrix, bound, cells, k: int, metric: str):
    queries = QueryBlock(metric, qids, matrix)
    best = TopK(len(qids), k, bound)
    rows = np.arange(len(qids))
    for batch in batches:
        if batch.num_rows:
            ids, block = batch.column(0).to_numpy(), as_matrix(batch.column(1))
            if cells is None or block.shape[1] != matrix.shape[1] or np.isinf(best.limit).all():
                scan_block(best, queries, rows, ids, block)
            else:
                scan_cells(best, queries, cells, ids, block)
            best.settle()
    yield from result_batches(queries, best)


def topk_cells(shared, k: int, metric: str):
    """``mapInArrow`` body for ``(list, id, v)``: each row meets only the queries probing its list."""

    def run(batches):
        qids, matrix, lists, starts, members = shared.value
        queries = QueryBlock(metric, qids, matrix)
        best = TopK(len(qids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            ids, block = batch.column(1).to_numpy(), as_matrix(batch.column(2))
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)]):
                at = np.searchsorted(lists, cell[order[lo]])
                if at < len(lists) and lists[at] == cell[order[lo]]:
                    run_rows = order[lo:hi]
                    scan_block(best, queries, members[starts[at]:starts[at + 1]], ids[run_rows], block[run_rows])
            best.settle()
        yield from result_batches(queries, best)

    return run


def topk_pair(k: int, metric: str):
    """``cogroup().applyInArrow`` body: one base chunk ``(id, v)`` against one query chunk ``(qid, qv)``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _RESULT_SCHEMA.empty_table()
        queries = QueryBlock(
            metric, right.column("qid").to_numpy(), as_matrix(right.column("qv"))
        )
        best = TopK(right.num_rows, k)
        ids, block = left.column("id").to_numpy(), as_matrix(left.column("v"))
        step = max(1, SCORE_ELEMENTS // 256)
        for lo in range(0, len(ids), step):
            scan_block(best, queries, np.arange(right.num_rows), ids[lo:lo + step], block[lo:lo + step])
        return pa.Table.from_batches(list(result_batches(queries, best)), schema=_RESULT_SCHEMA)

    return run


WALK_FIELDS = "qid long, id long, part int, distance double, expanded boolean, near boolean"


class Shard:
    """Vectors and edges of one shard of a graph, for walks that stay inside it."""

    def __init__(self, table: pa.Table, metric: str):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        self.metric, self.ids = metric, ids[order]
        self.vectors = as_matrix(table.column("v")).astype(exact_type(metric), copy=False)[order]
        self.part = table.column("part").to_numpy()[order]
        passing = table.column("first").combine_chunks()
        self.passes = passing.is_valid().to_numpy(zero_copy_only=False)[order]
        self.passing = passing.fill_null(0).to_numpy()[order]
        lists = table.column("dst").combine_chunks()
        counts = np.zeros(len(ids), np.int64)
        held = lists.is_valid().to_numpy(zero_copy_only=False)
        counts[held] = np.diff(lists.offsets.to_numpy())[held]
        starts = np.concatenate([[0], np.cumsum(counts)])
        self.first, self.count = starts[:-1][order], counts[order]
        self.dst = lists.flatten().to_numpy()
        self.dst_part = table.column("dst_part").combine_chunks().flatten().to_numpy()
        self.visited = np.zeros(len(ids), bool)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ``ids`` in this shard; -1 for nodes of other shards."""
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        return np.where(self.ids[at] == ids, at, -1) if len(self.ids) else np.full(len(ids), -1)

    def measure(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return paired(self.metric, self.vectors[rows], query)

    def edges(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the edges of ``rows``."""
        counts = self.count[rows]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(self.first[rows], counts) + within

    def walk(self, query: np.ndarray, ids, distances, expanded, asked, ef: int, width: int | None, levels: int | None):
        """Expand a beam inside the shard: ``(row, distance, expanded)`` of all that was met, how many came with the beam, the beam, and edges out ``(id, part)``.

        Rows of the beam that lie in other shards are -1.
        """
        at = self.place(ids)
        local = at >= 0
        self.visited[at[local]] = True
        touched = [at[local]]
        fresh = self.place(np.unique(asked))
        fresh = fresh[(fresh >= 0)]
        fresh = fresh[~self.visited[fresh]]
        all_at, all_id, all_d, done = at, ids, distances, expanded.copy()
        out_id, out_part, level = [], [], 0
        while True:
            if len(fresh):
                self.visited[fresh] = True
                touched.append(fresh)
                all_at, all_id = np.append(all_at, fresh), np.append(all_id, self.ids[fresh])
                all_d = np.append(all_d, self.measure(query, fresh))
                done = np.append(done, np.zeros(len(fresh), bool))
            beam = _nearest(all_d, all_id, ef)
            todo = beam[(all_at[beam] >= 0) & ~done[beam]]
            if not len(todo) or (levels is not None and level >= levels):
                break
            todo, level = todo[:width], level + 1
            done[todo] = True
            edges = self.edges(all_at[todo])
            targets = self.dst[edges]
            to = self.place(targets)
            beyond = to < 0
            out_id.append(targets[beyond])
            out_part.append(self.dst_part[edges[beyond]])
            fresh = np.unique(to[~beyond])
            fresh = fresh[~self.visited[fresh]]
        self.visited[np.concatenate(touched)] = False
        far, where = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_id, out_part))
        far, first = np.unique(far, return_index=True)
        return all_at, all_d, done, len(ids), beam, far, where[first]


def _nearest(d: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` nearest by (distance, id), in that order; NaN distances come last."""
    if len(d) > 4 * n:
        near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
        if len(near) >= n:
            return near[np.lexsort((ids[near], d[near]))[:n]]
    return np.lexsort((ids, d))[:n]


def walk_shard(metric: str, ef: int, width: int | None, levels: int | None, keep: int | None = None, passing: bool = False):
    """``cogroup().applyInArrow`` body: a shard ``(id, part, v, first, dst, dst_part)`` and the queries ``(qid, qv, beam, asked)`` walking it.

    Rows out of it are WALK_FIELDS: what was measured or expanded; ``near`` rows are in the beam, edges that leave the shard have
    no distance. With ``keep``, for a shard that is the whole graph, only so many of the nearest rows come out: of
    the beam, or of all rows met that have a passing row (``first`` is the smallest id of these).
    """
    schema = pa.schema([
        ("qid", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("distance", pa.float64()), ("expanded", pa.bool_()), ("near", pa.bool_()),
    ])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        shard = Shard(left, metric)
        qids, queries = right.column("qid").to_numpy(), as_matrix(right.column("qv")).astype(exact_type(metric), copy=False)
        beams, asked = right.column("beam").combine_chunks(), right.column("asked").combine_chunks()
        found = []
        for i in range(len(qids)):
            ids, d, before = np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
            if beams[i].is_valid:
                rows = beams[i].values
                ids, d, before = (np.array(rows.field(n).to_numpy(zero_copy_only=False)) for n in ("id", "distance", "expanded"))
            wanted = asked[i].values.to_numpy() if asked[i].is_valid else np.empty(0, np.int64)
            at, distance, expanded, known, beam, far, where = shard.walk(queries[i], ids, d, before, wanted, ef, width, levels)
            if keep is None:
                kept = np.flatnonzero(np.r_[expanded[:known] & ~before, np.ones(len(at) - known, bool)])
            elif passing:
                kept = np.flatnonzero(shard.passes[at])
                kept = kept[_nearest(distance[kept], shard.passing[at[kept]], keep)]
            else:
                kept = beam[:keep]
            near = np.zeros(len(at), bool)
            near[beam] = True
            n, m = len(kept), len(far)
            found.append((
                np.full(n + m, qids[i]), np.r_[shard.ids[at[kept]], far], np.r_[shard.part[at[kept]], where], np.r_[distance[kept], np.zeros(m)],
                np.r_[expanded[kept], np.zeros(m, bool)], np.r_[near[kept], np.zeros(m, bool)], np.r_[np.zeros(n, bool), np.ones(m, bool)],
            ))
        qid, id_, part_, distance, expanded, near, unmeasured = (np.concatenate(c) for c in zip(*found))
        values = (pa.array(qid, pa.int64()), pa.array(id_, pa.int64()), pa.array(part_.astype(np.int32)),
                  pa.array(distance, mask=unmeasured, from_pandas=False), pa.array(expanded), pa.array(near))
        return pa.Table.from_arrays(list(values), schema=schema)

    return run


def cell_space(metric: str, matrix: np.ndarray, max_norm: float = 0.0, query: bool = False) -> np.ndarray:
    """Vectors as the Euclidean points that cells are formed on.

    Cosine: unit length. Inner product: one more coordinate that gives every
    base vector the same length, so nearest means largest product. Bits: 0/1.
    """
    if metric in BIT_METRICS:
        return unpack_bits(matrix, 64).astype(np.float64)
    points = matrix.astype(np.float64)
    if metric == "cosine":
        norms = np.sqrt(np.square(points).sum(axis=1))
        return points / np.where(norms == 0, 1.0, norms)[:, None]
    if metric == "ip":
        rest = np.square(max_norm) - np.square(points).sum(axis=1)
        extra = np.zeros(len(points)) if query else np.sqrt(np.maximum(rest, 0.0))
        return np.column_stack([points, extra])
    return points


def nearest_cells(shared, n: int, metric: str, vector_at: int, max_norm: float, query: bool):
    """``mapInArrow`` body: append the ``n`` nearest centroids of each row, nearest first.

    Centroids of packed words are met by counting bits, others in cell space.
    """

    def run(batches):
        numbers, centroids = shared.value
        packed = centroids.dtype.kind == "i"
        half = None if packed else np.square(centroids).sum(axis=1) / 2
        for batch in batches:
            points = np.empty((0, centroids.shape[1]))
            if batch.num_rows:
                points = as_matrix(batch.column(vector_at))
                points = points.astype(np.int64) if packed else cell_space(metric, points, max_norm, query)
            found = np.empty((len(points), n), dtype=np.int32)
            step = max(1, SCORE_ELEMENTS // len(numbers))
            for lo in range(0, len(points), step):
                block = points[lo:lo + step]
                scores = word_distances(metric, block, centroids) if packed else half - block @ centroids.T
                if n == 1:
                    best = scores.argmin(axis=1)[:, None]
                else:
                    best = np.argsort(scores, axis=1, kind="stable")[:, :n]
                found[lo:lo + step] = numbers[best]
            arrays = list(batch.columns) + [as_list_array(found)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names + ["cells"])

    return run


def to_cell_space(metric: str, max_norm: float):
    """``mapInArrow`` body: ``(v)`` batches to ``(point)`` batches for training centroids."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = cell_space(metric, as_matrix(batch.column(0)), max_norm)
                yield pa.RecordBatch.from_arrays([as_list_array(points)], names=["point"])

    return run
