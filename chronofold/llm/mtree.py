"""Exact top-k by inner product with M-trees.

Inner products become a metric by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have distance^2 = |q|^2 + M^2 - 2 q.x,
so nearest neighbours are the highest products.  Each partition's rows become
trees of pages once, written as a table; every block of queries reads them.
Each query goes through a tree best first, by its own queue of nodes; queries
that come to the same node at the same time share one matrix product.  Stored
distances to the parent pivot rule out pivots and rows before any distance to
them is computed.  Scores are exact integers: vectors too long for exact float64
products are kept out of the trees and scored with Python integers where a
float64 estimate does not rule them out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace
from .workers import tidy

#: Rows of a leaf page; children of an inner node; bytes of a tree's rows; components of a block of queries; squared norm below which products are exact.
PAGE, FANOUT, TREE_BYTES, BLOCK, EXACT = 256, 12, 8 << 20, 2 << 20, float(1 << 52)
#: Range of the long column that holds scores.
LONG = (1 << 63) - 1


class Rows:
    """Vectors of one length with their ids (``none``: null) and row keys."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, none: np.ndarray, keys: np.ndarray):
        self.rows, self.ids, self.none, self.keys = rows, ids, none, keys

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.rows[at], self.ids[at], self.none[at], self.keys[at])

    def offer(self, heap: list[tuple], k: int, at: np.ndarray, scores: list) -> None:
        """Put rows ``at`` on a heap of at most k (score, tie, -key), worst first; ties go to the smaller id, null ids last."""
        for score, i, none, key in zip(scores, self.ids[at].tolist(), self.none[at].tolist(), self.keys[at].tolist(), strict=True):
            entry = (score, -LONG - 1 if none else -i, -key)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


class MTree:
    """Bulk-loaded M-tree over integer rows (as float64, exact).

    ``nodes`` holds leaves (start, stop, spokes) over consecutive rows and inner
    nodes (pivots, radii, spokes, children).  ``spokes`` are the distances of a
    leaf's rows, in order, or of an inner node's pivots, to the pivot that
    stands for the node in its parent; the root has none.
    """

    def __init__(self, data: Rows, page: int = PAGE):
        norms = (data.rows * data.rows).sum(1)
        self.page, self.top = page, float(norms.max(initial=0.0))
        self.nodes: list[tuple] = []
        self.order: list[np.ndarray] = []
        self.placed = 0
        points = np.concatenate([data.rows, np.sqrt(np.maximum(0.0, self.top - norms))[:, None]], axis=1)
        self.root = self._build(points, data.rows, np.arange(len(data.rows)), None)
        self.data = data.take(np.concatenate(self.order) if self.order else np.zeros(0, np.int64))
        del self.order
        self._reset()

    def _reset(self) -> None:
        self.place = {key: i for i, key in enumerate(self.data.keys.tolist())}
        self.computed = self.spared = 0

    def _build(self, points: np.ndarray, rows: np.ndarray, at: np.ndarray, pivot: int | None) -> int:
        own = None if pivot is None else self._distances(points[at], points[[pivot]])[:, 0]
        if len(at) <= self.page:
            if own is not None:
                by = np.argsort(own, kind="stable")
                at, own = at[by], own[by]
            self.order.append(at)
            self.nodes.append((self.placed, self.placed + len(at), own))
            self.placed += len(at)
            return len(self.nodes) - 1
        chosen = np.unique(np.linspace(0, len(at) - 1, FANOUT).astype(int))
        d = self._distances(points[at], points[at[chosen]])
        nearest = d.argmin(1)
        if (nearest == nearest[0]).all():  # equal rows or one cluster: cut by size
            nearest = np.minimum(np.arange(len(at)) * FANOUT // len(at), len(chosen) - 1)
        used = np.unique(nearest)
        radii = np.array([d[nearest == k, k].max() for k in used])
        kids = [self._build(points, rows, at[nearest == k], at[chosen[k]]) for k in used]
        self.nodes.append((rows[at[chosen[used]]], radii, None if own is None else own[chosen[used]], kids))
        return len(self.nodes) - 1

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))

    def packed(self) -> bytes:
        """The tree in as few bytes as hold its integers exactly."""
        top = np.abs(self.data.rows).max(initial=0.0)
        small = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
        nodes = [(n[0].astype(small), *n[1:]) if len(n) == 4 else n for n in self.nodes]
        return pickle.dumps((self.page, self.top, self.root, nodes, self.data.rows.astype(small), self.data.ids, self.data.none, self.data.keys), protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.page, tree.top, tree.root, nodes, rows, ids, none, keys = pickle.loads(raw)
        tree.nodes = [(n[0].astype(np.float64), *n[1:]) if len(n) == 4 else n for n in nodes]
        tree.data = Rows(rows.astype(np.float64), ids, none, keys)
        tree._reset()
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, heaps: list[list[tuple]]) -> None:
        """Update each query's heap, of at most k entries (see :meth:`Rows.offer`), leaving out the row of key ``own``.

        What other trees gave bounds the search of this one.
        """
        if not len(self.data.keys):
            return
        norm = (queries * queries).sum(1)
        slack = 1e-6 * (1.0 + np.sqrt(norm + self.top))  # distances are rounded, scores are not
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        with np.errstate(invalid="ignore"):
            limit = np.sqrt(np.maximum(0.0, norm + self.top - 2 * worst)) + slack
        mine = np.array([self.place.get(key, -1) for key in own.tolist()])
        queues = [[(0.0, self.root, np.nan)] for _ in heaps]
        active = list(range(len(heaps)))
        while active:
            groups: dict[int, list[tuple[int, float]]] = {}
            for i in active:
                bound, node, to_pivot = heapq.heappop(queues[i])
                if bound <= limit[i]:
                    groups.setdefault(node, []).append((i, to_pivot))
            for node, members in groups.items():
                at, to_pivot = np.array([i for i, _ in members]), np.array([d for _, d in members])
                if len(self.nodes[node]) == 4:
                    self._descend(self.nodes[node], at, to_pivot, queries, norm, limit, queues)
                    continue
                for g, places, scores in self._scan(self.nodes[node], at, to_pivot, queries, limit, worst, mine, k):
                    i = at[g]
                    self.data.offer(heaps[i], k, places, scores)
                    if len(heaps[i]) == k:
                        worst[i] = heaps[i][0][0]
                        limit[i] = np.sqrt(max(0.0, norm[i] + self.top - 2 * worst[i])) + slack[i]
            active = [i for members in groups.values() for i, _ in members if queues[i]]

    def _descend(self, node: tuple, at, to_pivot, queries, norm, limit, queues) -> None:
        pivots, radii, spokes, kids = node
        reach = limit[at][:, None]
        maybe = np.ones((len(at), len(kids)), bool) if spokes is None else np.abs(to_pivot[:, None] - spokes) - radii <= reach
        wanted = np.flatnonzero(maybe.any(0))
        self.computed += int(maybe.sum())
        self.spared += int((~maybe).sum())
        d = np.sqrt(np.maximum(0.0, norm[at][:, None] + self.top - 2 * queries[at] @ pivots[wanted].T))
        lower = d - radii[wanted]
        for g, c in zip(*np.nonzero(maybe[:, wanted] & (lower <= reach)), strict=True):
            heapq.heappush(queues[at[g]], (float(lower[g, c]), kids[wanted[c]], float(d[g, c])))

    def _scan(self, node: tuple, at, to_pivot, queries, limit, worst, mine, k: int) -> Iterator[tuple[int, np.ndarray, list]]:
        """(query of the group, places, scores) of a leaf's rows that may be among its best."""
        start, stop, spokes = node
        low, high = np.zeros(len(at), np.int64), np.full(len(at), stop - start)
        if spokes is not None:  # stored distances to the pivot rule out the rest
            low, high = np.searchsorted(spokes, to_pivot - limit[at]), np.searchsorted(spokes, to_pivot + limit[at], "right")
        self.computed += int(np.maximum(high - low, 0).sum())
        self.spared += int((stop - start) * len(at) - np.maximum(high - low, 0).sum())
        a, b = int(low.min()), int(high.max())
        if a >= b:
            return
        scores = queries[at] @ self.data.rows[start + a : start + b].T
        place = np.arange(a, b)
        good = (scores >= worst[at][:, None]) & (place >= low[:, None]) & (place < high[:, None]) & (place + start != mine[at][:, None])
        for g in np.flatnonzero(good.any(1)):
            found = np.flatnonzero(good[g])
            if len(found) > k:
                found = found[scores[g, found] >= np.partition(scores[g, found], len(found) - k)[len(found) - k]]
            yield g, start + a + found, scores[g, found].tolist()


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (array<double> of integers floor(scale * x)); null vectors and those with null or non-finite components are left out."""

    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # larger ones are integers

    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(vector_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, whole).alias("v"))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """``rows`` by a power of two, so that products neither overflow nor lose digits."""
    return np.ldexp(rows, -int(np.frexp(np.abs(rows).max(initial=0.0))[1]))


class LongVectors:
    """Rows that are scored by Python integers, unless a float64 estimate rules them out."""

    def __init__(self, data: Rows):
        self.data, self.low = data, _scaled(data.rows)
        self.size = np.abs(self.low)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple]) -> None:
        """Update one query's heap as :meth:`MTree.search` does."""
        q = _scaled(query)
        estimate = self.low @ q
        error = (len(q) + 4) * 2.0**-51 * (self.size @ np.abs(q)) + 1e-290
        at = np.flatnonzero(self.data.keys != own)
        if len(at) > k:
            least = np.partition((estimate - error)[at], len(at) - k)[len(at) - k]
            at = at[(estimate + error)[at] >= least]
        wanted = [int(x) for x in query]
        self.data.offer(best, k, at, [sum(int(x) * y for x, y in zip(row, wanted, strict=True)) for row in self.data.rows[at].tolist()])


def place_of(score: int) -> str:
    """Sorts as the scores do, by itself where they leave the range of a long; "5" within it."""
    if -LONG - 1 <= score <= LONG:
        return "5"
    n, bits = abs(score), abs(score).bit_length()
    digits = -(-bits // 4)
    if score > 0:
        return f"9{bits:05d}{n:0{digits}x}"
    return f"1{99999 - bits:05d}{(1 << bits) - n:0{digits}x}"


STORED = "kind string, key long, vec_id long, v array<double>, pages binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind "tree" (pages of an M-tree), "long" (rows beyond float64 products), "query" (rows that are asked)."""
    from pyspark import TaskContext

    names = [f.split()[0] for f in STORED.split(", ")]
    base, seen = TaskContext.get().partitionId() << 40, 0
    held: dict[int, list[Rows]] = {}

    def blobs(parts: list[Rows]) -> pa.RecordBatch:
        data = Rows(*[np.concatenate(x) for x in zip(*((p.rows, p.ids, p.none, p.keys) for p in parts), strict=True)])
        with np.errstate(over="ignore"):
            fits = (data.rows * data.rows).sum(1) < EXACT
        out = []
        if fits.any():
            out.append(("tree", MTree(data.take(np.flatnonzero(fits))).packed()))
        if not fits.all():
            rest = data.take(np.flatnonzero(~fits))
            out.append(("long", pickle.dumps((rest.rows, rest.ids, rest.none, rest.keys), protocol=5)))
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.float64())), pa.array([b for _, b in out], pa.binary())], names=names)

    for batch in batches:
        lists, ids = batch.column("v"), batch.column("vec_id")
        none, n = np.asarray(ids.is_null()), batch.num_rows
        number, keys = ids.fill_null(0).to_numpy(), base + seen + np.arange(n)
        seen += n
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for width in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == width)
            step = max(1, TREE_BYTES // (8 * width + 64))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                held.setdefault(width, []).append(Rows(flat[offsets[part][:, None] + np.arange(width)], number[part], none[part], keys[part]))
                if sum(len(r.keys) for r in held[width]) >= step:
                    yield blobs(held.pop(width))
        asked = batch.column("asked")
        if asked.true_count:
            m = asked.true_count
            yield pa.RecordBatch.from_arrays([pa.array(["query"] * m), pa.array(keys).filter(asked), ids.filter(asked), lists.filter(asked).cast(pa.list_(pa.float64())), pa.nulls(m, pa.binary())], names=names)
    for parts in held.values():
        yield blobs(parts)


FOUND = "query long, query_id long, vec_id long, score long, place string"


def _search(shared, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, groups = shared.value  # of one block; a group is (places in the block, matrix) of one vector length
        heaps: list[list] = [[] for _ in keys]
        exact: list[list] = [[] for _ in keys]  # apart, as the bounds of the trees are floats
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("pages"), strict=True):
                if kind == "tree":
                    tree = MTree.unpacked(raw.as_py())
                    data = tree.data
                else:
                    tree, data = None, Rows(*pickle.loads(raw.as_py()))
                for at, matrix in groups:
                    if matrix.shape[1] != data.rows.shape[1]:
                        continue
                    with np.errstate(over="ignore"):
                        plain = (matrix * matrix).sum(1) < EXACT
                    if tree is not None and plain.any():
                        easy = np.flatnonzero(plain)
                        tree.search(matrix[easy], keys[at[easy]], k, [heaps[i] for i in at[easy]])
                    hard = np.flatnonzero(~plain) if tree is not None else np.arange(len(at))
                    if len(hard):
                        beyond = LongVectors(data)
                        for i in hard:
                            beyond.search(matrix[i], int(keys[at[i]]), k, exact[at[i]])
        out = []
        for q, heap, big in zip(range(len(keys)), heaps, exact, strict=True):
            out += [(q, None if tie == -LONG - 1 else -tie, int(score)) for score, tie, _ in heapq.nlargest(k, heap + big)]
        if out:
            which, row, score = zip(*out, strict=True)
            place = [place_of(s) for s in score]
            score = [s if p == "5" else None for s, p in zip(score, place, strict=True)]
            which = np.array(which)
            columns = [pa.array(keys[which]), pa.array([ids[q] for q in which], pa.int64()), pa.array(row, pa.int64()), pa.array(score, pa.int64()), pa.array(place, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])

    return rows


def top_k(vectors: DataFrame, asked: Column | str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of ``vectors`` (vec_id, v) that ``asked`` selects, itself left out.

    The M-trees are built once.  Queries are taken in blocks of at most
    ``block`` vector components, streamed through the driver; each is one pass
    over the trees.  Rows are themselves, whatever ids they share: each asked
    row has a list of its own, and other rows of its id are candidates.  Ties go
    to the smaller vec_id, null ids last.  Only vectors of the query's length
    are compared.  Ranks are exact at any size; a score that no long can hold is
    null.  An empty table gives an empty result.
    """
    if k < 1 or block < 1:
        raise ValueError("k and block must be positive")
    spark, best = vectors.sparkSession, None
    marked = vectors.select("vec_id", "v", F.coalesce(F.expr(asked) if isinstance(asked, str) else asked, F.lit(False)).alias("asked"))
    index = Workspace(spark, "mtree").table(marked.mapInArrow(tidy(_index), STORED), "index")
    pages = index.where("kind <> 'query'").select("kind", "pages")
    held: list = []

    def ask() -> DataFrame:
        groups = []
        sizes = np.array([len(r.v) for r in held])
        for width in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == width)
            groups.append((at, np.array([held[i].v for i in at], float).reshape(len(at), width)))
        shared = spark.sparkContext.broadcast((np.array([r.key for r in held], np.int64), [r.vec_id for r in held], groups))
        return pages.mapInArrow(tidy(_search(shared, k)), FOUND)

    size = 0
    for r in index.where("kind = 'query'").select("key", "vec_id", "v").toLocalIterator():
        held.append(r)
        size += len(r.v) + 1
        if size >= block:
            best = ask() if best is None else best.union(ask())
            held, size = [], 0
    if held:
        best = ask() if best is None else best.union(ask())
    if best is None:
        best = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("place"), F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k for the rows whose vec_id is divisible by ``every``, against all other rows; other columns are not read."""
    return top_k(integer_vectors(embeddings), F.col("vec_id") % every == 0, k)
