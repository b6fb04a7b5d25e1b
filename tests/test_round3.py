"""Cases of the third round's findings, each of which failed before."""

import math

import numpy as np
from pyspark.sql import functions as F

from skein.functions import rounded
from skein.operators import atoms as A
from skein.operators import evaluate as E
from skein.operators import poses as P
from skein.sources import files, matrices
from skein.plans import similarity as S
from skein.plans.graph import components
from skein.sources.fixtures import gene_dist_of, linking_genes, near_genes, view


def test_histogram_bins_are_floors_of_quotients(spark):
    """0.6 / 0.2 is below 3 in binary."""
    preds = [0.6, 1.4, 4.999999, 5.0, -0.1, 0.2, None, 2.3]
    got = {r.bin: r.n for r in E.histogram(spark.createDataFrame([(p,) for p in preds], "pred double"), 0.0, 5.0, 25).collect()}
    want = {}
    for p in preds:
        b = None if p is None else 0 if p < 0 else 26 if p >= 5 else math.floor(p / 0.2) + 1
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_rounding_is_that_of_the_sql(spark):
    """Ties of the scaled double go away from zero, whatever its decimal text."""
    import duckdb

    rng = np.random.default_rng(5)
    values = [float(np.float32(v)) for v in rng.normal(size=3000)] + [(k + 0.5) / 1e6 for k in range(-500, 500)] + [0.0, 1e308, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = [r.v for r in df.select("i", rounded(F.col("v"), 6).alias("v")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 6))", [values]).fetchall()[0][0]][0]
    assert got == want


def test_complexes_are_dealt_over_all_tasks(spark):
    """A few bytes of poses become whole receptors: not one task's work."""
    poses = spark.createDataFrame([(i, f"M{i % 2}", 1, "C.3", 0.0, 0.0, 0.0) for i in range(64)], "complex_id long, model_name string, ord int, atom_type string, x double, y double, z double").coalesce(1)
    receptors = spark.createDataFrame([(f"M{i % 2}", i, "C.3", 1.0, 2.0, 3.0) for i in range(10)], "model_name string, ord int, atom_type string, x double, y double, z double")
    made = A.assemble(poses, receptors).where("part = 0")
    assert made.count() == 64 * 5 and made.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def _suppliers(spark, path):
    """Balances on the bounds of bands, equal ones and one that is null."""
    rows = [(i, [-50.0, 0.0, 0.01, 100.0, 100.01, 199.99, 250.5, None][i % 8] if i < 40 else 37.25 * i) for i in range(90)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_near_genes_are_the_view_up_to_a_limit_and_no_one_task_has_them(spark, tmp_path):
    d = _suppliers(spark, tmp_path)
    every = lambda df: sorted(map(tuple, df.collect()))
    for limit in (0.1, 1.0, 3.0):
        assert every(near_genes(spark, d, limit)) == every(view(spark, d, "fx_gene_dist").where(F.col("dist") <= limit))
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(near_genes(spark, d, 1.0)) > 1 == parts(view(spark, d, "fx_gene_dist").where("dist <= 1"))


def test_distances_of_pairs_are_those_of_the_view(spark, tmp_path):
    d = _suppliers(spark, tmp_path)
    pairs = spark.createDataFrame([(str(i), str((i * 7) % 90)) for i in range(90)] + [("A1", "5"), (None, "3"), ("5", "4"), ("4", "5")], "a string, b string")
    asked = {frozenset(r) for r in pairs.collect()}
    want = sorted(tuple(r) for r in view(spark, d, "fx_gene_dist").where("dist IS NOT NULL").collect() if frozenset((r.a, r.b)) in asked)
    assert sorted(tuple(r) for r in gene_dist_of(spark, d, pairs).where("dist IS NOT NULL").collect()) == want


def test_stored_complexes_hold_no_receptor(spark):
    fan = spark.createDataFrame([("g", str(i), "M1", "1-1", "KD", 1.0, k, "test") for i in range(3) for k in (1, 2)] + [("g", "9", "M2", "1-1", "KD", 1.0, 1, "test")], "gene string, compound string, model_name string, pose_id string, dataset string, expt double, cv int, cvset string")
    atoms = spark.createDataFrame([(m, "1-1", o, "C.3", float(o), 0.0, 0.0) for m in ("M1", "M2") for o in (1, 3)], "model_name string, pose_id string, ord int, atom_type string, x double, y double, z double")
    receptors = spark.createDataFrame([("M1", i, "C.3", 1.0 * i, 2.0, 3.0) for i in range(50)], "model_name string, ord int, atom_type string, x double, y double, z double")
    stored = P.stored_complexes(fan, atoms, receptors)
    assert "receptor" not in stored.columns and stored.count() == 7
    assert {(r.model_name, r.center.x, r.reject_reason) for r in stored.collect()} == {("M1", 2.0, None), ("M2", 2.0, "no receptor")}
    whole = {r.name: r.receptor for r in P.with_receptors(stored, receptors).collect()}
    assert [a.x for a in whole["g|1_KD"]] == [i - 2.0 for i in range(50)] and whole["g|9_KD"] is None


def test_voxels_take_tasks_by_atoms(spark, monkeypatch):
    monkeypatch.setattr(A, "DEALT", 5)
    atoms = spark.createDataFrame([(i // 2, float(i % 7), 0.0, 0.0) for i in range(100)], "complex_id long, x double, y double, z double")
    grid = A.voxelize(atoms, {"n": F.lit(1.0)}, n=2)
    assert grid.agg(F.sum("n")).first()[0] == 200 and grid.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_folders_of_lines_are_numbered_as_one_file(spark, tmp_path):
    rows = [(f, i, f"{f}{i}") for f in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "file string, i int, value string").repartition(3)
    df.repartitionByRange(6, "file", "i").sortWithinPartitions("file", "i").select("value", "file").write.partitionBy("file").text(f"{tmp_path}/t")
    got = files.read_lines(spark, f"{tmp_path}/t/*/*.txt", folders=True)
    assert sorted((r.file[-1], r.ord - 1, r.value) for r in got.collect()) == sorted(rows)


def test_names_of_archives_are_listed_without_their_matrices(spark, tmp_path):
    """And archives that NumPy wrote, compressed or not, are read as those of the writer."""
    for save, name in ((np.savez, "x"), (np.savez_compressed, "y")):
        save(f"{tmp_path}/{name}.npz", **{f"{name}/data": np.arange(6, dtype=np.float32).reshape(2, 3), f"{name}/affinity": np.float64(2)})
    listed = spark.read.format("matrices") if spark.dataSource.register(matrices.MatrixSource) is None else None
    assert sorted((r.name, r.data) for r in listed.option("names", "true").load(str(tmp_path)).collect()) == [("x", None), ("y", None)]
    assert sorted((r.name, r.data, r.affinity) for r in matrices.read_matrices(spark, str(tmp_path)).collect()) == [(n, [[0, 1, 2], [3, 4, 5]], 2.0) for n in "xy"]


def test_blocks_of_collocations_bound_a_workers_memory():
    """Some 8 MB of text in one batch: the numbers of a block, not of the batch, are held at once."""
    import tracemalloc

    import pyarrow as pa

    from skein.llm import collocations

    words = np.random.default_rng(3).integers(0, 5000, 1_600_000)
    text = [" ".join(f"w{w}" for w in part) for part in np.array_split(words, 800)]
    batch = pa.record_batch({"text": pa.array(text), "lang": pa.array(["en"] * len(text))})
    tracemalloc.start()
    n = sum(len(w) for w, *_ in collocations._blocks(iter([batch]), collocations.BLOCK_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(words) and peak < 60e6


def test_linking_genes_join_what_near_genes_join_and_grow_with_the_genes(spark, tmp_path):
    d = _suppliers(spark, tmp_path)
    parts = lambda edges, limit: sorted(map(tuple, components(edges.where(F.col("dist") <= limit)).collect()))
    near, linking = near_genes(spark, d, 3.0), linking_genes(spark, d, 3.0)
    for limit in (0.0, 0.1, 1.0, 3.0):
        assert parts(linking, limit) == parts(near, limit)
    assert {tuple(r) for r in linking.collect()} <= {tuple(r) for r in near.collect()}
    assert linking.count() <= 4 * 90 < near.count()


def test_a_complete_table_is_made_without_a_shuffle_of_pairs(spark, tmp_path):
    from skein import queries as Q

    rows = [(i, 37.25 * (i % 11), 7 if i % 5 == 0 else 1) for i in range(40)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = Q.kinase_distance(spark, str(tmp_path))
    alias = view(spark, str(tmp_path), "fx_alias")
    genes = spark.createDataFrame([(str(i),) for i in range(40)], "g string").union(alias.select("alias"))
    want = S.complete(genes, S.with_aliases(view(spark, str(tmp_path), "fx_gene_dist"), alias)).select("a", "b", F.round("dist", 6).alias("dist"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 48 * 48
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_forest_of_close_sets_joins_them_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = np.random.default_rng(8)
    sets = {str(i): {int(e) for e in np.flatnonzero(rng.random(40) < 0.55)} for i in range(150)} | {"x": {1}, "y": {2}, "z": set()}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "compound string, bits array<int>")
    want = {(a, b): 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: d for p, d in want.items() if d <= 0.6}
    every = {(r.a, r.b): r.dist for r in S.jaccard_pairs(df, 0.6).collect()}
    links = {(r.a, r.b): r.dist for r in S.jaccard_pairs(df, 0.6, forest=True).collect()}
    assert every == want and links.items() <= every.items() and len(links) < len(every) / 2
    joined = lambda found: sorted(map(tuple, components(spark.createDataFrame(sorted(found), "a string, b string")).collect()))
    assert joined(links) == joined(every)
