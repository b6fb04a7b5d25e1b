"""Connected components over an edge table, in O(log n) contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import materialize

#: Labels that are sent to all tasks at most.
FEW = 300_000


def _relabelled(edges: DataFrame, labels: DataFrame, ends: dict[str, str]) -> DataFrame:
    """``edges`` with their ends replaced by their labels, under new names. The labels are hashed, sent to all tasks if they are few, and the edges stream by: no task sorts or holds edges."""
    few = labels.count() <= FEW
    for of, to in ends.items():
        own = labels.toDF(of, to)
        edges = edges.join(F.broadcast(own) if few else own.hint("shuffle_hash"), of).drop(of)
    return edges


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, v)``: a random number of each end of ``edges(a, b)``; and the edges with numbers ``u, v`` for ends.

    XXH64 of one long is one to one, so different vertices have different numbers. Minima of longs
    are kept in a hash table, those of text would sort all edges.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = materialize(ends.withColumn("v", F.xxhash64(F.monotonically_increasing_id())))
    return ids, _relabelled(edges, ids, {"a": "u", "b": "v"})


def _both_ways(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Each edge from either end, in one reading."""
    rest = [c for c in edges.columns if c not in (u, v)]
    ends = F.explode(F.array(F.struct(F.col(u).alias(u), F.col(v).alias(v)), F.struct(F.col(v).alias(u), F.col(u).alias(v)))).alias("s")
    return edges.select(ends, *rest).select("s.*", *rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; component = smallest id reachable.

    Each round hooks a vertex to its neighbour with the smallest random number (so hooking
    chains stay short), follows two hooks, relabels both edge ends and drops loops
    and repeats. At least half of the vertices of every unfinished component go in
    expectation, so the loop ends after about log2(largest component) rounds. A hub costs
    nothing special: the minimum is combined map-side, and joins on a hub are inner or left
    equi-joins that AQE can split. A task holds vertices in its hash tables, never edges: repeats
    go only once the first round has contracted. Only "is an edge left" reaches the driver. Null
    ends and loops are ignored; an empty input gives an empty result.
    """
    kind = dict(edges.dtypes)[a]
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(edges)
    if edges.isEmpty():
        return edges.select(F.col("a").cast(kind).alias("id"), F.col("b").cast(kind).alias("component"))
    ids, edges = _numbered(edges)
    named = materialize(ids.join(_contracted(materialize(edges), max_rounds), "v").select("id", "root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    return named.join(least, "root").select("id", "component")


def _contracted(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, root)`` of the ends of a scratch table of edges ``u, v`` between random numbers: one end of each component."""
    assigned = None
    for _ in range(max_rounds):
        hook = _both_ways(edges, "u", "v").groupBy("u").agg(F.least("u", F.min("v")).alias("m")).toDF("v", "m")
        hook = materialize(hook)
        for _ in range(2):
            hook = hook.join(hook.toDF("m", "m2"), "m").select("v", F.col("m2").alias("m"))
        hook = materialize(hook)
        if assigned is None:
            assigned = hook.toDF("v", "root")
        else:
            step = hook.toDF("root", "m")
            assigned = materialize(assigned.join(step, "root", "left").select("v", F.coalesce("m", "root").alias("root")))
        moved = _relabelled(edges, hook, {"u": "mu", "v": "mv"}).where("mu <> mv")
        edges = materialize(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
        if edges.isEmpty():
            return assigned
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def label_vertices(vertices: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``components`` plus the vertices that no edge touches, each its own component."""
    found = components(edges).withColumnRenamed("id", key)
    return vertices.select(key).distinct().join(found, key, "left").select(key, F.coalesce("component", key).alias("component"))


def _lightest(live: DataFrame) -> DataFrame:
    """The lightest edge at each ``u``: by length, then by the edge's number. Minima of numbers, one after the other, need no sort."""
    best = _both_ways(live, "u", "v")
    for key in ("dist", "e"):
        best = materialize(_met(best, best.groupBy("u").agg(F.min(key).alias("least"))).where(F.col(key) == F.col("least")).drop("least"))
    return best


def _met(rows: DataFrame, least: DataFrame) -> DataFrame:
    return rows.join(least.hint("shuffle_hash"), "u")


def spanning_forest(edges: DataFrame, limit: float | None = None, max_rounds: int = 60) -> DataFrame:
    """``a, b, dist``: a minimum spanning forest of an edge table, by Boruvka's rounds.

    In each round every tree takes the lightest edge that leaves it (edges of one length are
    told apart by their numbers, so no cycle closes), and what those edges join is contracted. Trees at least halve, so the rounds are logarithmic; edges within a tree go. The single-linkage clusters of *any* threshold are the
    components of the forest's edges up to it, and a forest has fewer edges than vertices.
    ``limit``: longer edges are of no interest. Null ends and distances, and loops, are ignored.
    """
    real = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b AND dist IS NOT NULL")
    own = real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("dist").cast("double").alias("dist"))
    if limit is not None:
        own = own.where(F.col("dist") <= limit)
    ids, numbered = _numbered(materialize(own))
    live = materialize(numbered.select("u", "v", "dist", F.monotonically_increasing_id().alias("e"), F.col("u").alias("a"), F.col("v").alias("b")))
    taken = live.limit(0).select("dist", "e", "a", "b")
    for _ in range(max_rounds):
        if live.isEmpty():
            ends = _relabelled(taken, ids.select("v", "id"), {"a": "x", "b": "y"})
            return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
        best = _lightest(live)
        taken = materialize(taken.union(best.select(*taken.columns).distinct()))
        into = _contracted(best.select("u", "v"))
        live = materialize(_relabelled(live, into, {"u": "x", "v": "y"}).where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"), "dist", "e", "a", "b"))
    raise RuntimeError(f"the forest didn't settle in {max_rounds} rounds")
