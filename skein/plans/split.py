"""Leakage-free splits: clusters, quotas and the greedy grid of kinase and compound thresholds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import sample_key
from skein.plans.graph import label_vertices, spanning_forest
from skein.sources.scratch import materialize

SUBSETS = ["xtal", "nonbind", "high", "low"]


def clusters(vertices: DataFrame, edges: DataFrame | None, limit: float, key: str) -> DataFrame:
    """``key, cluster``: single linkage cut at ``limit``, which is the components of the edges up to it; all one cluster without ``edges``, as at the largest distance there is."""
    if edges is None:
        least = vertices.agg(F.min(key).alias("cluster"))
        return vertices.select(key).distinct().crossJoin(F.broadcast(least))
    return label_vertices(vertices.select(key), edges.where(F.col("dist") <= limit).select("a", "b"), key).withColumnRenamed("component", "cluster")


#: Edges as a table, or a function from a table of members to edges among them that join the same members at each threshold as all of theirs.
Edges = DataFrame | Callable[[DataFrame], DataFrame]


def edges_among(edges: Edges, members: DataFrame, key: str) -> DataFrame:
    """Edges between ``members(key)``: made for them, or those of the table that have both ends there."""
    if callable(edges):
        return edges(members.select(key)).select("a", "b", "dist")
    ends = members.select(key).distinct()
    return edges.join(ends.toDF("a"), "a", "left_semi").join(ends.toDF("b"), "b", "left_semi").select("a", "b", "dist")


def recut(of: DataFrame, left: DataFrame, edges: Edges, limit: float, key: str) -> DataFrame:
    """The clusters ``of(key, cluster)`` of what is ``left`` of their members.

    Clusters that lost all or none of their members are as they were; only those that lost some
    are cut anew, from the edges among the members left, since the lost ones may have held them
    together.
    """
    marked = materialize(of.join(left.select(key).distinct().withColumn("stays", F.lit(True)), key, "left"))
    torn = marked.groupBy("cluster").agg(F.bool_or(F.col("stays").isNull()).alias("some"), F.bool_or(F.col("stays").isNotNull()).alias("rest")).where("some AND rest").select("cluster")
    stays = marked.where("stays").select(key, "cluster")
    again = materialize(stays.join(torn, "cluster", "left_semi").select(key))
    if again.isEmpty():
        return stays
    inner = edges_among(edges if callable(edges) else edges.where(F.col("dist") <= limit), again, key).where(F.col("dist") <= limit)
    anew = label_vertices(again, inner.select("a", "b"), key).withColumnRenamed("component", "cluster")
    return materialize(stays.join(torn, "cluster", "left_anti").select(key, "cluster").union(anew))


def cluster_sizes(members: DataFrame, degrees: DataFrame, key: str) -> DataFrame:
    """Members and size in pairs of each cluster; ``degrees(key, num)`` count the whole input."""
    return members.join(degrees, key, "left").groupBy("cluster").agg(F.count("*").alias("n_members"), F.coalesce(F.sum("num"), F.lit(0)).alias("n_pairs"))


def majority(members: DataFrame, docked: DataFrame, key: str) -> DataFrame:
    """Share of docked members and whether they are more than half."""
    marked = members.join(docked.select(key).distinct().withColumn("is_docked", F.lit(1.0)), key, "left")
    out = marked.groupBy("cluster").agg(F.avg(F.coalesce("is_docked", F.lit(0.0))).alias("share"))
    return out.withColumn("docked", F.col("share") > 0.5)


def eligible(members: DataFrame, degrees: DataFrame, docked: DataFrame, key: str, limit: int) -> DataFrame:
    """Clusters of at most ``limit`` pairs with their class."""
    return cluster_sizes(members, degrees, key).where(F.col("n_pairs") <= limit).join(majority(members, docked, key), "cluster")


@dataclass
class Quotas:
    """Pairs wanted of each subset, in the order of SUBSETS; a shortage moves to ``low`` if it is small enough, else the attempt fails."""

    want: dict[str, int]
    slack: int = 3
    carry: int = 0

    def _take(self, subset: str, have: int, fails: bool) -> int | None:
        want = self.want.get(subset, 0) + (self.carry if subset == "low" else 0)
        if fails:
            return None
        short = max(0, want - have)
        self.carry += short
        self.want[subset] = self.want.get(subset, 0) - short
        return want - short

    def wanted(self, subset: str) -> int:
        return self.want.get(subset, 0) + (self.carry if subset == "low" else 0)

    def meet(self, subset: str, have: int, exact: bool = False) -> int | None:
        """How many to take where ``have`` can be met; none at all is no failure but for ``low``. ``low`` must have more than its quota, or with ``exact`` as many."""
        want = self.wanted(subset)
        low = subset == "low" and (have < want or (have == want and not exact))
        return self._take(subset, have, low or (have > 0 and want - have > self.slack))

    def keep(self, subset: str, left: int) -> int | None:
        """The same after clusters were filtered: any shortage beyond the slack fails."""
        short = self.wanted(subset) - left
        return self._take(subset, left, short > 0 and (subset == "low" or short > self.slack))


def size_cutoff(sizes: DataFrame, at: int, limit: int) -> int:
    """Element ``at`` (from 0) of the ascending ``n_pairs``, at most ``limit``: from the counts of the few sizes there are, not from a sort of all rows."""
    counts = sizes.groupBy("n_pairs").agg(F.count("*").alias("n"))
    run = counts.select("n_pairs", F.sum("n").over(Window.orderBy("n_pairs")).alias("upto"))
    return min(run.where(F.col("upto") > at).agg(F.min("n_pairs")).first()[0], limit)


def sample_members(pool: DataFrame, genes: DataFrame, of: DataFrame, degrees: DataFrame, quotas: Quotas, size_limit: int, seed: object) -> tuple[DataFrame, str | None]:
    """All pairs of the sampled compound clusters, subset by subset, with the sampled genes; and the subset that failed, if one did.

    ``nth`` = 1 marks the pair sampled of a cluster, the others are its other members: first a
    compound of the cluster is drawn, then one of the genes that it meets.

    ``of(compound, cluster)``. All clusters that a subset's compounds meet give the soft size
    cut-off: with m of them, element max(quota - 1, round(m / 2)) of their sizes; clusters above
    it, and those used for an earlier subset, then go. Counts and one size a subset reach the
    driver.
    """
    near = pool.join(genes.select("gene").distinct(), "gene", "left_semi").join(of, "compound").join(cluster_sizes(of, degrees, "compound").select("cluster", "n_pairs"), "cluster")
    near = materialize(near)
    got = near.limit(0).select("gene", "compound", "subset", "cluster", F.lit(1).alias("nth"))
    for subset in SUBSETS:
        own = near.where(F.col("subset") == subset)
        met = materialize(own.select("cluster", "n_pairs").distinct())
        m = met.count()
        want = quotas.meet(subset, m)
        if want is None:
            return got.limit(0), subset
        if m == 0:
            continue
        cutoff = size_cutoff(met, min(m - 1, max(want - 1, round(m / 2))), size_limit)
        left = materialize(met.where(F.col("n_pairs") <= cutoff).join(got.select("cluster"), "cluster", "left_anti"))
        want = quotas.keep(subset, left.count())
        if want is None:
            return got.limit(0), subset
        chosen = left.orderBy(sample_key(seed, "cluster"), "cluster").limit(want).select("cluster")
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy(sample_key(seed, "compound"), "compound", sample_key(seed, "gene"), "gene"))
        members = own.join(chosen, "cluster", "left_semi").select("gene", "compound", "subset", "cluster").withColumn("nth", nth)
        got = materialize(got.union(members))
    return got, None


def sample_compounds(pool: DataFrame, genes: DataFrame, of: DataFrame, degrees: DataFrame, quotas: Quotas, size_limit: int, seed: object) -> tuple[DataFrame, str | None]:
    """The pairs that ``sample_members`` samples: one a compound cluster."""
    got, failed = sample_members(pool, genes, of, degrees, quotas, size_limit, seed)
    return got.where("nth = 1").drop("nth"), failed


def sample_pairs(pool: DataFrame, genes: DataFrame, quotas: Quotas, seed: object) -> tuple[DataFrame, str | None]:
    """Pairs at random, without clusters, from the ``genes`` that other thresholds have sampled already."""
    near = materialize(pool.join(genes.select("gene").distinct(), "gene", "left_semi"))
    got = near.limit(0).select("gene", "compound", "subset")
    for subset in SUBSETS:
        own = near.where(F.col("subset") == subset).select("gene", "compound", "subset")
        want = quotas.meet(subset, own.count(), exact=True)
        if want is None:
            return got.limit(0), subset
        got = got.union(own.orderBy(sample_key(seed, "gene", "compound"), "gene", "compound").limit(want))
    return materialize(got), None


#: A threshold that stands for sampling without clusters.
RANDOM = "random"
#: Gene clusters sampled in random mode, and attempts, by class.
RANDOM_CLUSTERS, RETRIES = {"docked": 33, "xtal": 300}, {"docked": 10, "xtal": 3}
RECORD = "gene string, compound string, subset string, cluster string, kthresh string, cvset string, atype string, cthresh string"
SPLIT = "gene string, compound string, kthresh string, cvset string, atype string, cthresh string, status string"


def cv_split(
    pairs: DataFrame,
    gene_edges: Edges,
    compound_edges: Edges,
    docked: DataFrame,
    gene_limits: list[float | str],
    compound_limits: list[float | str],
    quota: dict[str, int],
    size_limit: int,
    share: float = 0.1,
    seed: object = 0,
    retries: dict[str, int] | None = None,
    random_clusters: dict[str, int] | None = None,
) -> DataFrame:
    """The sets of ``split_and_record`` without the record."""
    return split_and_record(pairs, gene_edges, compound_edges, docked, gene_limits, compound_limits, quota, size_limit, share, seed, retries, random_clusters)[0]


def split_and_record(
    pairs: DataFrame,
    gene_edges: Edges,
    compound_edges: Edges,
    docked: DataFrame,
    gene_limits: list[float | str],
    compound_limits: list[float | str],
    quota: dict[str, int],
    size_limit: int,
    share: float = 0.1,
    seed: object = 0,
    retries: dict[str, int] | None = None,
    random_clusters: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``gene, compound, kthresh, cvset, atype, cthresh, status``: the sets of the grid, and ``training`` for what is left; and the record of the other members of sampled clusters (``gene, compound, subset, cluster, kthresh, cvset, atype, cthresh``).

    For each gene threshold, class of gene cluster (docked or crystal, by majority) and set, a
    share of the class's clusters is sampled, twice as many being needed; for each compound
    threshold pairs of those genes are sampled, one a compound cluster. Clusters, and the share
    taken of them, are of the genes and compounds that are left then; their sizes in pairs are
    those of the whole input. Each axis has one spanning forest, whose cuts are the clusters of
    all its thresholds; only clusters that lost some members are cut anew. Where all edges are too many, a
    function makes those that it takes among the members left (``Edges``). Crystal clusters give
    crystal pairs only. Used compound clusters leave the pool at once; gene clusters that gave a
    pair leave it after the last compound threshold, others stay for later. RANDOM as a gene
    threshold makes each pair a cluster and removes no genes; as a compound threshold it takes
    pairs of the clusters that gave some before. An attempt that can't meet its quotas is rolled
    back and tried with other clusters; a set that fails for good is a row without a pair, with
    the reason as status, and ends its class. The pool is a scratch table; the driver sees
    counts only.
    """
    retries, random_clusters = retries or RETRIES, random_clusters or RANDOM_CLUSTERS
    spark = pairs.sparkSession
    pool = materialize(pairs.select("gene", "compound", "subset").distinct())
    by_gene = materialize(pool.groupBy("gene").agg(F.count("*").alias("num")))
    by_compound = materialize(pool.groupBy("compound").agg(F.count("*").alias("num")))
    known = lambda e, of, key: e if callable(e) else materialize(edges_among(e, of, key))
    gene_edges, compound_edges = known(gene_edges, by_gene, "gene"), known(compound_edges, by_compound, "compound")

    def cuts(of, e, key, limits):
        limits = [x for x in limits if x != RANDOM]
        forest = spanning_forest(edges_among(e, of, key) if callable(e) else e, max(limits)) if limits else None
        return {x: materialize(clusters(of, forest, x, key)) for x in limits}

    first_genes, compound_of = cuts(by_gene, gene_edges, "gene", gene_limits), cuts(by_compound, compound_edges, "compound", compound_limits)
    is_docked = docked.select("gene").distinct().withColumn("is_docked", F.lit(True))
    text = lambda v: F.lit(str(v))
    parts, others, failures = [], [], []
    for k in gene_limits:
        if k == RANDOM:
            # A cluster a pair; its gene is known by itself, so nothing else goes with it.
            gene_of = materialize(by_gene.select("gene", F.col("gene").alias("cluster")))
            fit = materialize(pool.join(is_docked, "gene", "left").select(F.concat_ws("|", "gene", "compound").alias("cluster"), "gene", F.coalesce("is_docked", F.lit(False)).alias("docked")))
        else:
            gene_of = recut(first_genes[k], pool, gene_edges, k, "gene")
            fit = materialize(eligible(gene_of, by_gene, docked, "gene", size_limit).select("cluster", "docked"))
            total = {r["docked"]: r["n"] for r in majority(gene_of, docked, "gene").groupBy("docked").agg(F.count("*").alias("n")).collect()}
        for atype in ("docked", "xtal"):
            own = fit.where(F.col("docked") == (atype == "docked"))
            n = random_clusters[atype] if k == RANDOM else round(share * total.get(atype == "docked", 0))
            if own.count() < 2 * n or not n:
                failures.append((str(k), "validation", atype, "not enough gene clusters"))
                continue
            taken = own.limit(0).select("cluster")
            for cvset in ("validation", "test"):
                failed = None
                for attempt in range(retries[atype]):
                    tag = f"{seed}|{k}|{atype}|{cvset}|{attempt}"
                    sampled = materialize(own.join(taken, "cluster", "left_anti").orderBy(sample_key(tag, "cluster"), "cluster").limit(n))
                    genes = materialize(sampled.select("gene").distinct() if k == RANDOM else gene_of.join(sampled, "cluster", "left_semi").select("gene"))
                    trial, found, beside, failed, now = pool, [], [], None, dict(compound_of)
                    gave = gene_of.limit(0).select("cluster")
                    for c in compound_limits:
                        usable = trial if atype == "docked" else trial.where("subset = 'xtal'").withColumn("subset", F.lit("low"))
                        if c == RANDOM:
                            got, failed = sample_pairs(usable, genes.join(gene_of, "gene").join(gave, "cluster", "left_semi"), Quotas(dict(quota)), f"{tag}|{c}")
                        else:
                            now[c] = recut(now[c], trial, compound_edges, c, "compound")
                            members, failed = sample_members(usable, genes, now[c], by_compound, Quotas(dict(quota)), size_limit, f"{tag}|{c}")
                            got = members.where("nth = 1")
                        if failed:
                            failed = f"not enough of {failed} at {c}"
                            break
                        cell = [text(k).alias("kthresh"), text(cvset).alias("cvset"), text(atype).alias("atype"), text(c).alias("cthresh")]
                        found.append(got.select("gene", "compound", *cell, text("ok").alias("status")))
                        if c != RANDOM:
                            beside.append(members.where("nth > 1").select("gene", "compound", F.lit("xtal").alias("subset") if atype == "xtal" else "subset", "cluster", *cell))
                        gave = materialize(gave.union(got.join(gene_of, "gene").select(gene_of["cluster"])).distinct())
                        if c == RANDOM:
                            trial = materialize(trial.join(got, ["gene", "compound"], "left_anti"))
                        else:
                            used = now[c].join(got.select("cluster").distinct(), "cluster", "left_semi").select("compound")
                            trial = materialize(trial.join(used, "compound", "left_anti"))
                    if not failed:
                        gone = gene_of.join(gave, "cluster", "left_semi").select("gene")
                        pool = trial if k == RANDOM else materialize(trial.join(gone, "gene", "left_anti"))
                        taken = materialize(taken.union(sampled.select("cluster")))
                        parts, others, compound_of = parts + found, others + beside, now
                        break
                if failed:
                    failures.append((str(k), cvset, atype, failed))
                    break
    none = F.lit(None).cast("string")
    out = pool.select("gene", "compound", none.alias("kthresh"), F.lit("training").alias("cvset"), none.alias("atype"), none.alias("cthresh"), F.lit("ok").alias("status"))
    for x in parts:
        out = out.union(x)
    record = spark.createDataFrame([], RECORD)
    for x in others:
        record = record.union(x)
    return out.union(spark.createDataFrame([(None, None, k, cvset, atype, None, why) for k, cvset, atype, why in failures], SPLIT)), record


def leaks(split: DataFrame, edges: DataFrame, key: str, limit: str) -> DataFrame:
    """Sampled pairs whose compound (or gene) is within its own threshold of one in training: must be empty; random thresholds promise nothing."""
    test = split.where(F.col("cvset") != "training").select(key, F.col(limit).try_cast("double").alias("most")).where("most IS NOT NULL").distinct()
    train = split.where("cvset = 'training'").select(F.col(key).alias("b")).distinct()
    both = edges.select("a", "b", "dist").union(edges.select("b", "a", "dist"))
    same = test.join(train, F.col(key) == F.col("b"), "left_semi").select(F.col(key).alias("id"), "most", F.col(key).alias("b"), F.lit(0.0).alias("dist"))
    near = test.join(both, F.col(key) == F.col("a")).where("dist <= most").join(train, "b", "left_semi").select(F.col(key).alias("id"), "most", "b", "dist")
    return same.union(near)
