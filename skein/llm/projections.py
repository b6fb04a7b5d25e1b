"""Operator 12: nearest neighbours by low-dimensional stable projections under a kd-tree.

The largest inner product becomes the least Euclidean distance once a vector gets one more
component, ``sqrt(M^2 - |x|^2)``, with M the largest norm of its band of norms; queries get a
zero there. A few Gaussian (2-stable) projections keep the ratio of projected to true squared
distance at a chi-square law of as many degrees. The projected space of each band is cut by a
kd-tree fitted on a bounded sample; its leaves are cells, every row is put into its cell, and
large cells are dealt into blocks with a kd-tree of their own. A search visits projected
neighbours leaf by leaf, nearest first, verifies each on the original vectors, and stops when
the chi-square test holds: a row beyond the reach
``true distance of the k-th found * sqrt(chi-square quantile)`` would be among the k nearest
with a probability below ``1 - sure``. It runs twice: in the cell of the query itself, which
gives a first bound, then in the other cells within reach.

Equal vectors are searched and stored once, with the smallest ids of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID
from skein.sources.scratch import materialize

#: Rows that the upper tree is fitted on, about; cells at most: an eighth of them.
SAMPLE_ROWS = 1 << 17
SEED = 11
#: Width of a band of norms, as a part of an octave.
BANDS = 4
LEAF = 128
FOUND = "q long, v long, score double, ids array<long>"


def quantile(sure: float, degrees: int) -> float:
    """Chi-square quantile for an even number of degrees, by bisection."""
    if degrees % 2 or not 0 < sure < 1:
        raise ValueError("an even number of projections and a probability below one are asked for")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < sure else (low, mid)
    return high


def matrix(vec: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
    flat, lengths = np.asarray(vec.flatten(), np.float64), np.asarray(pc.list_value_length(vec))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def project(x: np.ndarray, top: np.ndarray | None, degrees: int) -> np.ndarray:
    """Projections of rows (``top``: the largest norm of each row's band) or, without it, of queries."""
    axes = np.random.default_rng(SEED).standard_normal((degrees, x.shape[1] + 1))  # rows: the same whatever the degrees
    out = x @ axes[:, :-1].T
    if top is not None:
        out += np.sqrt(np.maximum(0, top**2 - (x**2).sum(1)))[:, None] * axes[:, -1]
    return out


class Cells:
    """A kd-tree's leaves as boxes, with the cuts that lead to them."""

    def __init__(self, points: np.ndarray, least: int):
        """Halves of ``points`` at the median of their widest axis, down to ``least`` points."""
        self.cuts, self.low, self.high, self.order = [], [], [], []
        full = np.full(points.shape[1], np.inf)
        self._split(points, np.arange(len(points)), -full, full, least)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> int:
        """Number of the node made; leaves count from -1 down."""
        if len(own) > least:
            p = points[own]
            axis = int(np.argmax(p.max(0) - p.min(0)))
            at = float(np.median(p[:, axis]))
            left = p[:, axis] < at
            if left.any():
                node = len(self.cuts)
                self.cuts.append(None)
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = at
                self.cuts[node] = (axis, at, self._split(points, own[left], low, below, least), self._split(points, own[~left], above, high, least))
                return node
        self.low.append(low)
        self.high.append(high)
        self.order.append(own)
        return -len(self.low)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0 if self.cuts else -1, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -node - 1
                continue
            axis, at, below, above = self.cuts[node]
            left = points[own, axis] < at
            todo += [(below, own[left]), (above, own[~left])]
        return out

    def apart(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each leaf's box."""
        out = np.zeros((len(points), len(self.low)))
        for axis in range(points.shape[1]):
            p = points[:, axis, None]
            out += np.maximum(np.maximum(self.low[:, axis] - p, p - self.high[:, axis]), 0) ** 2
        return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def search(x: np.ndarray, v: np.ndarray, first_id: np.ndarray, top: float, q: np.ndarray, bound: np.ndarray, keep: int, degrees: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)`` of the ``keep`` best rows of a block for each query, as far as the stopping test asks.

    ``bound``: the score that a row must reach (or -inf). Ties go to the smaller first id.
    """
    p, pq = project(x, np.full(len(x), top), degrees), project(q, None, degrees)
    tree = Cells(p, LEAF)
    for k, own in enumerate(tree.order):  # the leaf's own box is tighter than its part of the space
        tree.low[k], tree.high[k] = p[own].min(0), p[own].max(0)
    apart = tree.apart(pq)
    order = np.argsort(apart, 1)
    square, slack = (q**2).sum(1), 1e-12 * np.sqrt((q**2).sum(1)) * top
    bound, empty = bound.copy(), np.zeros(0, np.int64)
    best_q, best_x, best_s = empty, empty, np.zeros(0)
    rank = np.lexsort((v, first_id))
    place = np.empty(len(v), np.int64)
    place[rank] = np.arange(len(v))
    active = np.arange(len(q))
    for step in range(order.shape[1]):
        leaf = order[active, step]
        far = apart[active, leaf]
        with np.errstate(invalid="ignore"):
            left = square[active] + top**2 - 2 * bound[active]
            going = ~np.isfinite(bound[active]) | (far <= np.maximum(left, 0) * reach + 1e-9)
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        new_q, new_x = [], []
        by = np.argsort(leaf, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            rows, asks = tree.order[leaf[own[0]]], active[own]
            s = q[asks] @ x[rows].T
            least = bound[asks]
            if len(rows) > keep:
                least = np.maximum(least, np.partition(s, len(rows) - keep, 1)[:, len(rows) - keep])
            i, j = np.nonzero(s >= (least - slack[asks])[:, None])
            new_q.append(asks[i])
            new_x.append(rows[j])
        i, j = np.concatenate(new_q), np.concatenate(new_x)
        best_q, best_x, best_s = np.append(best_q, i), np.append(best_x, j), np.append(best_s, inner(q[i], x[j]))
        o = np.lexsort((place[best_x], -best_s, best_q))
        best_q, best_x, best_s = best_q[o], best_x[o], best_s[o]
        first = np.searchsorted(best_q, best_q)
        ok = np.arange(len(best_q)) - first < keep
        best_q, best_x, best_s = best_q[ok], best_x[ok], best_s[ok]
        last = np.flatnonzero(np.append(best_q[1:] != best_q[:-1], True)) if len(best_q) else empty
        full = last[last - np.searchsorted(best_q, best_q[last]) + 1 == keep]
        bound[best_q[full]] = np.maximum(bound[best_q[full]], best_s[full])
    return best_q, best_x, best_s


def usable(table: DataFrame, vector: str, id_column: str) -> DataFrame:
    """``id`` (null: NO_ID), ``vec`` of the rows that take part: vectors neither null nor zero, without null or non-finite components."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(c, lambda e: e != 0)
    return table.where(c.isNotNull()).where(fine).select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), c.alias("vec"))


def neighbours(table: DataFrame, is_query, k: int = 20, vector: str = "embedding", id_column: str = "vec_id", degrees: int = 8, sure: float = 0.98, cell_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, ``is_query(id column)`` naming the queries.

    Score: inner product of the original vectors in double precision; ties go to the smaller
    id. Vectors null, zero or holding null or non-finite components take no part; a shorter
    vector counts as filled up with zeros. Rows of one id and vector are one row; rows of one
    id with different vectors are each a query, and candidates of each other. A row without an
    id is a candidate of the smallest id, named null, never a query. Fewer rows than ``k`` give
    fewer neighbours; an empty table gives an empty result. The index holds every row.
    """
    rows = usable(table, vector, id_column)
    reach = quantile(sure, degrees)
    # A vector's k + 1 smallest ids are all that can be among the k nearest of any query.
    numbered = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
    ids = numbered.where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    stored = materialize(ids.withColumn("v", F.monotonically_increasing_id()))
    asked = materialize(rows.where(is_query(F.col("id")) & (F.col("id") != NO_ID)).distinct().join(stored.select("vec", "v"), "vec").select("id", F.col("v").alias("q")))
    queries = asked.select("q").distinct().join(stored.select(F.col("v").alias("q"), "vec"), "q")
    width = stored.agg(F.max(F.size("vec"))).first()[0] or 1
    spark, none = table.sparkSession, spark_none(table.sparkSession)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    banded = stored.withColumn("norm", norm).withColumn("band", F.round(F.log2("norm") * BANDS).cast("int"))
    tops = {r.band: (r.top, r.n) for r in banded.groupBy("band").agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect()}  # a band a quarter octave: some thousands at most
    if not tops:
        return none
    total = sum(n for _, n in tops.values())
    part = min(1.0, SAMPLE_ROWS / total)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band = np.asarray(b["band"])
            p = project(matrix(b["vec"], width), np.array([tops[x][0] for x in band.tolist()]), degrees)
            yield pa.record_batch({"band": b["band"], "p": pa.array(p.tolist(), pa.list_(pa.float64()))})

    chosen = banded.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = chosen.select("vec", "band").mapInArrow(projected, "band int, p array<double>").toArrow()
    at, trees, first_cell, n_cells = np.asarray(sample["band"]), {}, {}, 0
    points = matrix(sample["p"], degrees)
    for band in sorted(tops):
        trees[band] = Cells(points[at == band], max(8, int(cell_rows * part)))
        first_cell[band], n_cells = n_cells, n_cells + len(trees[band].low)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, band = matrix(b["vec"], width), np.asarray(b["band"])
            cell = np.zeros(len(x), np.int64)
            for k_band in np.unique(band).tolist():
                own = band == k_band
                cell[own] = first_cell[k_band] + trees[k_band].of(project(x[own], np.full(own.sum(), tops[k_band][0]), degrees))
            yield pa.record_batch({"cell": pa.array(cell), "v": b["v"], "vec": b["vec"], "ids": b["ids"]})

    kind = dict(stored.dtypes)["vec"]
    index = materialize(banded.select("v", "vec", "ids", "band").mapInArrow(put, f"cell long, v long, vec {kind}, ids array<long>"))
    # A row a cell: there are never more than an eighth of the sample's rows, and one a band.
    blocks = {r.cell: -(-r.n // cell_rows) for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(int(c), int(n)) for c, n in blocks.items()], "cell long, blocks long")
    index = index.join(F.broadcast(sizes), "cell")
    index = index.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).drop("blocks")

    def deal(home: bool):
        """Queries to blocks: those of their own cells, or all others within reach."""

        def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 24) // (width + 1) // n_cells)  # queries whose copies fit a batch
            for whole in batches:
                for s in range(0, whole.num_rows, step):
                    yield from one(whole.slice(s, step))

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = matrix(b["vec"], width)
            p, square = project(x, None, degrees), (x**2).sum(1)
            bound = None if home else np.asarray(b["bound"].fill_null(-np.inf))
            for band, tree in trees.items():
                own, top = tree.of(p), tops[band][0]
                if home:
                    i, cell = np.arange(len(p)), own
                else:
                    left = np.maximum(square + top**2 - 2 * bound, 0)
                    # Nothing of a band is nearer than its largest norm allows.
                    some = np.sqrt(square) * top * (1 + 1e-12) >= bound
                    near = (tree.apart(p) <= (left * reach + 1e-9)[:, None]) & some[:, None]
                    near[np.arange(len(p)), own] = False
                    i, cell = np.nonzero(near)
                n = np.array([blocks.get(first_cell[band] + c, 0) for c in range(len(tree.low))], np.int64)[cell]
                i, cell = np.repeat(i, n), np.repeat(cell, n)
                block = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(i)
                yield pa.record_batch({"cell": pa.array(first_cell[band] + cell), "block": pa.array(block), "q": b["q"].take(take), "vec": b["vec"].take(take), "bound": pa.nulls(len(i), pa.float64()) if home else b["bound"].take(take)})

        return to_blocks

    band_of = {first_cell[b] + c: b for b in trees for c in range(len(trees[b].low))}

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        top = tops[band_of[key[0].as_py()]][0]
        x, v, id_lists = matrix(left["vec"], width), np.asarray(left["v"]), left["ids"].combine_chunks()
        first_id = np.asarray(pc.list_element(id_lists, 0))
        i, j, score = search(x, v, first_id, top, matrix(right["vec"], width), np.asarray(right["bound"].fill_null(-np.inf)), k + 1, degrees, reach)
        return pa.table({"q": np.asarray(right["q"])[i], "v": v[j], "score": score, "ids": id_lists.take(pa.array(j))})

    def run(dealt: DataFrame) -> DataFrame:
        """Blocks with over ``cell_rows`` queries are copied for each share of them, so that no group grows."""
        dealt = materialize(dealt)
        share = dealt.groupBy("cell", "block").agg(F.ceil(F.count("*") / cell_rows).alias("shares"))
        rows = index.join(share, ["cell", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        asks = dealt.join(share, ["cell", "block"]).withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares"))).drop("shares")
        keys = ["cell", "block", "share"]
        return materialize(rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(look, FOUND))

    schema = f"cell long, block long, q long, vec {kind}, bound double"
    found = run(queries.select("q", "vec").mapInArrow(deal(True), schema))
    bound = found.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q", F.when(F.size("s") > k, F.element_at("s", k + 1)).alias("bound"))
    if n_cells > len(trees):
        others = queries.join(bound, "q", "left").select("q", "vec", "bound")
        found = found.union(run(others.mapInArrow(deal(False), schema)))
    each = found.select("q", "v", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id", "v")
    best = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id", (F.col("v") == F.col("q")).alias("own")))).alias("best"))
    of = asked.join(best, "q").select(F.col("id").alias("query_id"), F.filter("best", lambda e: ~(e["own"] & (e["id"] == F.col("id")))).alias("best"))
    ranked = of.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("e.id") != NO_ID, F.col("e.id")).alias("vec_id"), F.col("e.score").alias("score"))


def spark_none(spark) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
