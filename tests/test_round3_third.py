"""Cases of the third part of the third round's findings, each of which failed before."""

import numpy as np
from pyspark.sql import functions as F

from skein.operators import atoms as A
from skein.operators import poses as P
from skein.plans.split import clusters, recut
from skein.sources.fixtures import linking_genes, near_genes


def test_occupied_cells_score_as_dense_grids_do_without_making_them(spark):
    """A box of 1,200 cells a side can't be made densely."""
    rng = np.random.default_rng(4)
    rows = [(int(i), *map(float, rng.integers(-9, 10, 3)), float(rng.random())) for i in np.repeat(np.arange(40), 6)] + [(None, 0.0, 0.0, 0.0, 1.0)]
    atoms = spark.createDataFrame(rows, "complex_id long, x double, y double, z double, w double")
    features = {"n": F.lit(1.0), "w": F.col("w")}

    def of(box):
        def load():
            return lambda n, grid, cell, values: np.bincount(grid, (values * ((cell % box) + 1)[:, None]).sum(1), n)

        return load

    def dense():
        return lambda grids: (grids.sum(-1) * (np.arange(21) + 1)).sum((1, 2, 3))

    want = {r.complex_id: round(r.score, 9) for r in A.score_batches(A.voxelize(atoms, features).where("complex_id IS NOT NULL"), ["n", "w"], dense, 7, dtype="float64").collect()}
    for batch in (1, 7, 4096):
        got = A.score_occupied(A.placed_atoms(atoms, ordered=True), features, of(21), batch)
        assert {r.complex_id: round(r.score, 9) for r in got.collect()} == want
    wide = A.score_occupied(A.placed_atoms(atoms, box=1200, reach=600.0, ordered=True), features, lambda: lambda n, grid, cell, values: np.bincount(grid, values[:, 0], n), 64, 1200)
    assert {r.complex_id: r.score for r in wide.collect()} == dict.fromkeys(range(40), 6.0)
    assert A.score_occupied(A.placed_atoms(atoms.limit(0), ordered=True), features, of(21)).count() == 0


def test_genes_that_are_left_are_cut_by_links_made_for_them(spark, tmp_path):
    """The few links of all genes don't join those that are left once some between them went; the edges of all pairs aren't needed."""
    rows = [(i, 10.0 * (i * 7 % 60)) for i in range(60)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    d, limit = str(tmp_path), 0.5
    link = lambda left: linking_genes(spark, d, limit, left)
    genes = spark.createDataFrame([(str(i),) for i, _ in rows], "gene string")
    near = near_genes(spark, d, limit)
    of = clusters(genes, link(genes), limit, "gene")
    every = lambda df: sorted(map(tuple, df.select("gene", "cluster").collect()))
    assert every(of) == every(clusters(genes, near, limit, "gene"))
    for step in (2, 3, 5, 7):
        left = genes.where(F.col("gene").cast("int") % step != 0)
        got = recut(of, left, link, limit, "gene")
        assert every(got) == every(recut(of, left, near, limit, "gene"))
        assert link(left).count() <= 4 * left.count()


def test_scores_of_one_table_meet_as_in_the_join_after_one_shuffle(spark):
    rng = np.random.default_rng(2)
    one = lambda: tuple(None if v == 3 else float(v) for v in rng.integers(0, 4, 3))
    rows = [("g", str(i % 5), "M1", f"{i % 11}", *one()) for i in range(150)] + [("g", "0", "M1", "z", 0.0, 1.0, 1.0), ("g", "0", "M1", "z", -0.0, 1.0, 1.0), (None, "0", "M1", "1", 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "gene string, compound string, model_name string, pose_id string, distance double, energy_kcal double, kdmodel double")
    on = ["gene", "compound", "model_name", "pose_id"]
    want = P.score_join(*[table.select(*on, c) for c in ("distance", "energy_kcal", "kdmodel")])
    got = P.scores_joined(table)
    every = lambda df: sorted(map(repr, (tuple(0.0 if v == 0 else v for v in r) for r in df.collect())))
    assert every(got) == every(want) and got.columns == want.columns
    plan = P.scores_joined(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
