"""Cases of the fourth part of the third round's findings, each of which failed before."""

import numpy as np
from pyspark.sql import functions as F

from skein import queries as Q
from skein.operators import atoms as A


def test_atoms_are_turned_in_the_scorers_tasks_as_spark_turns_them(spark):
    """Halves, the box's edges, atoms of no voxel, missing values, and a complex of several batches."""
    rng = np.random.default_rng(7)
    at = lambda: [float(v) / 4 for v in rng.integers(-50, 51, 3)]
    rows = [(f"c{i}", *at(), float(rng.random())) for i in np.repeat(np.arange(60), 5)] + [("big", *at(), 1.0) for _ in range(25_000)]
    rows += [("far", 30.0, 0.0, 0.0, 1.0), ("half", None, 1.0, 1.0, 1.0), ("half", 1.0, 2.0, 3.0, 2.0), ("nan", float("nan"), 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    atoms = spark.createDataFrame(rows, "complex_id string, x double, y double, z double, w double")
    features = {"x": F.lit(1.0), "w": F.col("w")}

    def load():
        return lambda n, grid, cell, values: np.bincount(grid, (values * ((cell % 1009) + 1)[:, None]).sum(1), n)

    every = lambda df: {r.complex_id: round(r.score, 6) for r in df.collect()}
    for n in (1, 24):
        want = every(A.score_occupied(A.placed_atoms(atoms, n, ordered=True), features, load, 7))
        assert len(want) > 50 and {"big", "half"} < set(want) and not {"far", "nan", None} & set(want)
        for batch in (1, 64):
            assert every(A.score_turned(atoms, features, load, n, batch)) == want
    assert every(A.score_turned(atoms.limit(0), features, load)) == {}
    gaps = atoms.withColumn("w", F.when(F.col("w") < 0.5, F.col("w")))
    assert every(A.score_turned(gaps, features, load)) == every(A.score_turned(gaps.fillna(0.0, ["w"]), features, load))


def test_the_batched_scorer_gets_each_atom_once(spark):
    plan = Q.score_poses_in_batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
