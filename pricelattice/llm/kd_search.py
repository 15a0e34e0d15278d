"""Exact top-k search by inner product with a KD-tree in every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Vectors in a leaf, vectors in a shard, queries in a block, vectors of the pilot that gives first bounds and the cells, most cells.
LEAF, SHARD_ROWS, BLOCK_ROWS, PILOT_ROWS, MOST_CELLS = 128, 16_384, 512, 1_024, 128


class KDTree:
    """Median splits along the widest side, with the tight bounding box of every node.

    A split cuts the order at the middle, not at a value, so equal vectors are halved like any others. Nodes are
    numbered as in a heap: the children of i are 2i + 1 and 2i + 2.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        self.n_inner = (1 << depth) - 1
        order = np.arange(len(ids))
        nodes = [(0, len(ids))]
        low, high, ranges = [], [], []
        for level in range(depth + 1):
            below = []
            for lo, hi in nodes:
                part = order[lo:hi]
                box = vectors[part]
                low.append(box.min(axis=0))
                high.append(box.max(axis=0))
                ranges.append((lo, hi))
                if level < depth:
                    side = int(np.argmax(high[-1] - low[-1]))
                    mid = (hi - lo) // 2
                    order[lo:hi] = part[np.argpartition(box[:, side], mid)]
                    below += [(lo, lo + mid), (lo + mid, hi)]
            nodes = below
        self.ranges = ranges
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.vectors = ids[order], vectors[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(queries, self.low, self.high)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, scores, ids): all candidates for the k best of each query, the query's own id left out.

        Best-first: the open node with the largest bound comes next. ``kth`` is a score that k candidates are known
        to reach; it rises as leaves are read, and a node whose bound is below it ends the search. Candidates are
        distinct ids with the best score of their rows, so repeats do not raise it.
        """
        bounds = self.bounds(queries)
        for q in range(len(queries)):
            limit = kth[q]
            mine = bounds[q]
            heap = [(-mine[0], 0)]
            best: dict[int, float] = {}
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < limit:
                    break
                if node < self.n_inner:
                    for child in (2 * node + 1, 2 * node + 2):
                        if mine[child] >= limit:
                            heapq.heappush(heap, (-mine[child], child))
                    continue
                lo, hi = self.ranges[node]
                scores = self.vectors[lo:hi] @ queries[q]
                near = np.flatnonzero(scores >= limit)
                ids = self.ids[lo:hi][near]
                for s, i in zip(scores[near].tolist(), ids.tolist()):
                    if i != own[q] and s > best.get(i, -np.inf):
                        best[i] = s
                if len(best) >= k:
                    best = dict(heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0])))
                    limit = max(limit, min(best.values()))
            if best:
                found = sorted(best.items(), key=lambda x: (-x[1], x[0]))
                yield q, np.array([s for _, s in found]), np.array([i for i, _ in found], dtype=np.int64)


class Cells:
    """A partition of space by median splits of the pilot's vectors along their widest side: a KD-tree above the shards."""

    def __init__(self, pilot: np.ndarray, wanted: int) -> None:
        self.depth = min(MOST_CELLS, max(1, wanted)).bit_length() - 1 if len(pilot) else 0
        self.n = 1 << self.depth
        self.side, self.cut = np.zeros(self.n, np.int64), np.zeros(self.n)
        parts = {0: pilot}
        for node in range(self.n - 1):
            part = parts.pop(node)
            if len(part):
                self.side[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.cut[node] = np.median(part[:, self.side[node]])
            above = part[:, self.side[node]] >= self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~above], part[above]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (vectors[np.arange(len(vectors)), self.side[node]] >= self.cut[node])
        return node - (self.n - 1)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): no vector in a box has a larger inner product."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def grid(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part (no NULL, no non-finite component, ``dims`` components), and their floor(scale * x)."""
    sizes = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
    fit = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(fit)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), dims)
    ok = np.isfinite(x).all(axis=1)  # a NULL component is NaN here
    return fit[ok], np.floor(scale * x[ok])


def _packed(vectors: np.ndarray) -> bytes:
    return np.ascontiguousarray(vectors, dtype="<f8").tobytes()


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 1024, dims: int | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Components are floor(scale * x) and scores are exact integers (up to 2**53). Ties go to the smaller id; a query never
    finds its own id. Rows with a NULL id or a vector that is NULL, of another length, or holds NULL or
    non-finite components take no part. Rows that repeat an id count once for each query with their best score. Result: query_id, rank int (from 1), the id, score.

    1. Vectors, each once for its id, go to cells, the leaves of a KD-tree over a pilot of ``PILOT_ROWS`` vectors, and a cell of more than ``shard_rows``
       to several shards by a hash of id and vector. The tight boxes of the cells, ``MOST_CELLS`` at most, come to the driver.
    2. Every query first searches one shard of its own cell. The kth best score that it finds there, or among the pilot, is its bound.
    3. With that bound it goes on to those other cells whose boxes can hold a better score, and to the other shards of its own.

    In a shard's task the vectors come first and become a tree, then one block of queries after another is searched, so memory holds a shard and a
    block, whatever the number of queries. k rows a query leave a shard, and a window takes the k best of them.
    """
    spark = vectors.sparkSession
    if dims is None:
        row = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = row["n"] if row else 0
    none = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    if not dims:
        return none
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    n = rows.count()
    pilot_rows = rows.orderBy(F.xxhash64("id"), "id").limit(PILOT_ROWS).toArrow()
    fit, pilot = grid(pilot_rows.column("v").combine_chunks(), dims, scale) if n else (np.zeros(0, np.int64), np.zeros((0, dims)))
    cells = Cells(pilot, n // shard_rows)
    held = spark.sparkContext.broadcast((pilot_rows.column("id").to_numpy()[fit] if n else fit, pilot, cells))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, x = grid(batch.column(1), dims, scale)
            ids = batch.column(0).to_numpy()[fit]
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(held.value[2].of(x), pa.int32()), "id": pa.array(ids, pa.int64()), "data": pa.array([_packed(v) for v in x], pa.binary()),
            })

    packed = "cell int, id long, data binary"
    # Neither copies of a row nor the vectors of one id may fill a shard.
    there = stored(rows.mapInArrow(pack, packed).distinct(), "vectors")
    here = stored(asked.mapInArrow(pack, packed), "queries")
    boxes = _cell_boxes(there, dims)
    first, shards = {}, 0  # of each cell: its first shard and their number
    for c, (count, _, _) in sorted(boxes.items()):
        first[c] = (shards, max(1, -(-count // shard_rows)))
        shards += first[c][1]
    if not shards:
        return none
    names = spark.createDataFrame([(c, at, k) for c, (at, k) in first.items()], "cell int, at int, k int")
    placed = there.join(F.broadcast(names), "cell").select(
        (F.col("at") + F.pmod(F.xxhash64("id", "data"), "k")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "data", F.lit(None).cast("double").alias("kth")
    )
    low, high = np.array([boxes[c][1] for c in sorted(boxes)]), np.array([boxes[c][2] for c in sorted(boxes)])
    numbers = [first[c] for c in sorted(boxes)]
    own_cell = {c: i for i, c in enumerate(sorted(boxes))}

    def home(x: np.ndarray, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A shard of the query's own cell, or of the cell with the best bound where its own is empty."""
        at = np.array([own_cell.get(c, -1) for c in cell.tolist()], dtype=np.int64)
        empty = np.flatnonzero(at < 0)
        at[empty] = box_bounds(x[empty], low, high).argmax(axis=1)
        return np.array([numbers[c][0] + i % numbers[c][1] for c, i in zip(at.tolist(), ids.tolist())], dtype=np.int64)

    def route(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, dims)
                own = home(x, cell, ids)
                kth = batch.column(3).to_numpy(zero_copy_only=False) if later else np.full(len(ids), -np.inf)
                bounds = box_bounds(x, low, high) if later else None
                if later:
                    going = ((s, np.flatnonzero((own != s) & (bounds[:, c] >= kth))) for c in range(len(numbers)) for s in range(numbers[c][0], sum(numbers[c])))
                else:
                    going = ((s, np.flatnonzero(own == s)) for s in np.unique(own).tolist())
                for shard, use in going:
                    if len(use):
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array(np.full(len(use), shard, np.int32)), "kind": pa.array(np.ones(len(use), np.int32)), "id": pa.array(ids[use], pa.int64()),
                            "data": batch.column(2).take(pa.array(use)), "kth": pa.array(kth[use], pa.float64()),
                        })

        return run

    search = _searcher(held, dims, k)
    parts = min(shards, 20_000)

    def found(going: DataFrame) -> DataFrame:
        # Every shard is whole in one partition, and a partition has one shard, or a few one after another.
        dealt = placed.unionByName(going).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "kind", "id")
        return dealt.mapInArrow(search, "query_id long, id long, score long")

    way = "shard int, kind int, id long, data binary, kth double"
    near = stored(found(here.mapInArrow(route(False), way)), "near")
    score = near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    onward = here.join(kth, "id", "left").select("cell", "id", "data", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    far = found(onward.mapInArrow(route(True), way))
    whole = near.unionByName(far).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"
    )


def _cell_boxes(there: DataFrame, dims: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Vectors and tight box of each cell; tasks send on one row a cell and batch, and those of a cell meet in one task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, dims)
            yield from _boxes(batch.column(0).to_numpy(), np.ones(len(x), np.int64), x, x)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f8").reshape(-1, dims) for c in ("low", "high"))
            yield from _boxes(batch.column(0).to_numpy(), batch.column(1).to_numpy(), low, high)

    kind = "cell int, n long, low binary, high binary"
    rows = there.mapInArrow(part, kind).repartition("cell").mapInArrow(whole, kind).toArrow().to_pydict()
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for c, n, low, high in zip(rows["cell"], rows["n"], rows["low"], rows["high"]):
        low, high = np.frombuffer(low, "<f8"), np.frombuffer(high, "<f8")
        if c in out:
            n, low, high = n + out[c][0], np.minimum(low, out[c][1]), np.maximum(high, out[c][2])
        out[c] = (n, low, high)
    return out


def _boxes(cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(cell):
        return
    order = np.argsort(cell, kind="stable")
    own, at = np.unique(cell[order], return_index=True)
    yield pa.RecordBatch.from_pydict({
        "cell": pa.array(own, pa.int32()), "n": pa.array(np.add.reduceat(n[order], at), pa.int64()),
        "low": pa.array([_packed(v) for v in np.minimum.reduceat(low[order], at)], pa.binary()), "high": pa.array([_packed(v) for v in np.maximum.reduceat(high[order], at)], pa.binary()),
    })


def _searcher(held, dims: int, k: int):
    """From rows sorted by (shard, vectors before queries): the candidates for each query's k best."""

    def block_of(tree: KDTree, ids: list, data: list, kth: list) -> pa.RecordBatch | None:
        own, block = np.array(ids, np.int64), np.frombuffer(b"".join(data), "<f8").reshape(-1, dims)
        pilot_ids, pilot, _ = held.value
        limit = np.maximum(np.array(kth), _pilot_kth(block, own, pilot, pilot_ids, k))
        out = list(tree.search(block, own, k, limit))
        if not out:
            return None
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(own[[q for q, _, _ in out]], [len(i) for _, _, i in out]), pa.int64()),
            "id": pa.array(np.concatenate([i for _, _, i in out]), pa.int64()),
            "score": pa.array(np.concatenate([s for _, s, _ in out]).astype(np.int64), pa.int64()),
        })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard, before = None, None, 0
        ids, data, kths = [], [], []
        for batch in batches:
            for s, kind, i, x, kth in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if s != shard or kind != before or (kind and len(ids) == BLOCK_ROWS):
                    if before == 0 and ids:
                        tree = KDTree(np.array(ids, np.int64), np.frombuffer(b"".join(data), "<f8").reshape(-1, dims)) if s == shard else None
                    elif ids and tree and (out := block_of(tree, ids, data, kths)):
                        yield out
                    if s != shard:
                        tree = None
                    shard, before = s, kind
                    ids, data, kths = [], [], []
                ids.append(i)
                data.append(x)
                kths.append(kth)
        if before == 1 and ids and tree and (out := block_of(tree, ids, data, kths)):
            yield out

    return search


def _pilot_kth(block: np.ndarray, own: np.ndarray, pilot: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score that k other vectors reach, for each query; -inf where the pilot has fewer."""
    distinct = np.unique(ids, return_index=True)[1]
    ids, pilot = ids[distinct], pilot[distinct]
    if len(ids) <= k:
        return np.full(len(block), -np.inf)
    scores = block @ pilot.T
    scores[own[:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
