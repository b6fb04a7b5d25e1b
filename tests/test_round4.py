"""Cases of the fourth round's findings, each of which failed before."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from skein import queries as Q
from skein.operators import atoms as A
from skein.operators import poses as P
from skein.plans import similarity as S
from skein.sources import files, matrices


@pytest.mark.parametrize("postings", [2048, 3])
def test_sets_of_one_key_are_compared_each_by_itself(spark, postings, monkeypatch):
    """Repeated keys, null items, null keys: no pair is lost, in sparse sets."""
    monkeypatch.setattr(S, "POSTINGS", postings)
    rng = np.random.default_rng(6)
    sets = [(f"c{i % 25}", [int(e) for e in rng.choice(24, rng.integers(1, 8), False)]) for i in range(100)]
    sets += [("d1", [5000, None, 5001]), ("d2", [5000, None]), ("d2", [None, 5001, 5000]), (None, [5000, 5001])]
    want = []
    for a, x in sets:
        for b, y in sets:
            x_, y_ = {*x} - {None}, {*y} - {None}
            inter, union = len(x_ & y_), len(x_ | y_)
            if a and b and a < b and union - inter <= 0.6 * union + 1e-12:
                want.append((a, b, round(1 - inter / union, 9)))
    got = S.jaccard_pairs(spark.createDataFrame(sets, "compound string, bits array<int>"), 0.6).collect()
    assert sorted((r.a, r.b, round(r.dist, 9)) for r in got) == sorted(want) and len(want) > 50


def test_pairs_of_odd_embeddings_are_those_of_the_sql(spark, tmp_path):
    """Several embeddings of one id, without positive components, wide, missing."""
    import duckdb

    rng = np.random.default_rng(2)
    wide = lambda: [float(e) for e in rng.choice([-1.0, 1.0], 1300, p=[0.995, 0.005])]
    rows = [(i % 20, wide()) for i in range(60)] + [(i, [1.0, -1.0, 1.0, None]) for i in (3, 3, 30, 31)] + [(i, [-1.0, 0.0]) for i in (40, 41, 42, 42)] + [(50, None), (51, []), (None, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(Q.ORACLES["jaccard_pairs"]).fetchall()
    assert sorted(map(tuple, Q.jaccard_pairs(spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 12


def _bytes_a_row(df, path):
    """Of a table written as it comes."""
    df.write.parquet(path)
    return sum(f.stat().st_size for f in Path(path).glob("*.parquet")) / df.sparkSession.read.parquet(path).count()


def test_a_complete_table_takes_a_fraction_of_a_byte_a_row(spark, tmp_path):
    """The pairs are all there, in an order in which ids and distances repeat."""
    rows = [(i * 9 % 700, 37.25 * (i % 25), 7 if i % 70 == 0 else 1) for i in range(700)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = Q.kinase_distance(spark, str(tmp_path))
    assert _bytes_a_row(found, f"{tmp_path}/out") < 0.25
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 710 * 710


def test_complexes_take_a_fraction_of_a_byte_a_row(spark, tmp_path, monkeypatch):
    """Each pose becomes a whole receptor; ids of any type, missing ones too, and receptors too many to be sent."""
    poses = [(f"c{i}" if i else None, f"M{i % 3}" if i % 50 else None, 1 + k, "C.3", 0.5, 0.0, 0.0) for i in range(2000) for k in range(2)] + [("c1", "M2", 9, "H", 0.0, 0.0, 0.0), ("c1", "M9", 9, "H", 0.0, 0.0, 0.0)]
    poses = spark.createDataFrame(poses, "complex_id string, model_name string, ord int, atom_type string, x double, y double, z double")
    receptors = spark.createDataFrame([(f"M{i % 4}" if i % 9 else None, i, "H" if i % 3 else "C.3", i / 7, 2.0, 3.0) for i in range(900)], "model_name string, ord int, atom_type string, x double, y double, z double")
    made = A.assemble(poses, receptors)
    assert _bytes_a_row(made.where("part = 0"), f"{tmp_path}/out") < 0.6
    own = receptors.alias("r").join(poses.select("complex_id", "model_name").distinct().alias("p"), "model_name")
    want = own.selectExpr("complex_id", "0 AS part", "ord", "atom_type", "x", "y", "z").union(poses.selectExpr("complex_id", "1 AS part", "ord", "atom_type", "x", "y", "z"))
    assert made.count() == want.count() and made.exceptAll(want).isEmpty()
    monkeypatch.setattr(A, "SENT", 0)
    assert A.assemble(poses, receptors).exceptAll(want).isEmpty() and A.assemble(poses, receptors, True).count() == want.count() + own.count()
    assert A.assemble(poses.limit(0), receptors).count() == 0 and A.assemble(poses, receptors.limit(0)).count() == poses.count()


def test_small_matrices_take_few_bytes_in_archives(spark, tmp_path, monkeypatch):
    """Twenty bytes of cells don't take five hundred; NumPy alone reads them; blocks of any size, missing affinities, cells and rows."""
    want = {f"{i}|é{i % 3}_KD": ([[i / 4, None if i % 5 == 0 else 1.0, float(k)] for k in range(i % 4)], None if i % 7 == 0 else i / 2) for i in range(4000)}
    want |= {"empty rows": ([[], []], float("nan")), "": ([[1.0]], 0.0)}
    df = spark.createDataFrame([(k, *v) for k, v in want.items()], "name string, data array<array<double>>, affinity double").coalesce(2)
    plain = lambda m, v: (repr([[None if x is None or x != x else x for x in r] for r in m]), repr(v))
    matrices.write_matrices(df, path := str(tmp_path / "m"))
    got = {r.name: plain(r.data, r.affinity) for r in matrices.read_matrices(spark, path, 1000).collect()}
    assert got == {k: plain(*v) for k, v in want.items()}
    with pytest.raises(ValueError, match="occurs 2 times"):
        matrices.write_matrices(df.limit(1), path)
    monkeypatch.setattr(matrices, "BATCH", 40)
    rows = [(k, *v) for k, v in want.items()]
    blocks = list(matrices._blocks(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), matrices.ARROW.types, strict=True)], schema=matrices.ARROW)))
    again = pa.Table.from_batches([matrices._unblocked(*b) for b in blocks]).to_pylist()
    assert len(blocks) > 1000 and {r["name"]: plain(r["data"], r["affinity"]) for r in again} == got
    files = list((tmp_path / "m").glob("*.npz"))
    assert sum(f.stat().st_size for f in files) < 60 * len(want)
    with np.load(files[0]) as a:
        assert len(a["0/names"]) == a["0/shapes"][:, 0].sum() and len(a["0/values"]) == a["0/shapes"][:, 1:].prod(1).sum()


def test_stored_rows_are_dealt_once_and_written_as_they_lie(spark, tmp_path):
    """By pose, with the ligands; neither gathered by pair before nor dealt by fold for the writer."""
    fan = spark.createDataFrame([(f"g{i % 7}", str(i), f"M{i % 3}", f"{i % 40}-1", "KD", 1.0, k, "test") for i in range(200) for k in (1, 2)], "gene string, compound string, model_name string, pose_id string, dataset string, expt double, cv int, cvset string")
    atoms = spark.createDataFrame([(f"M{m}", f"{i}-1", o, "C.3", float(o), 0.0, 0.0) for m in range(2) for i in range(40) for o in (1, 3)], "model_name string, pose_id string, ord int, atom_type string, x double, y double, z double")
    receptors = spark.createDataFrame([("M1", 1, "C.3", 1.0, 2.0, 3.0)], "model_name string, ord int, atom_type string, x double, y double, z double")
    made = P.stored_complexes(fan, atoms, receptors)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(named_struct(dataset" not in plan and "collect_list(struct(dataset" not in plan
    rows = made.collect()
    assert len(rows) == 400 and {(r.model_name, r.ligand is None, r.reject_reason) for r in rows} == {("M0", False, "no receptor"), ("M1", False, None), ("M2", True, "no pose")}
    files.write_keyed(made, str(tmp_path / "t"), ["name"], ["cv", "cvset"], dealt=True)
    assert spark.read.parquet(str(tmp_path / "t")).select(*made.columns).exceptAll(made).isEmpty()
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.write_keyed(made.union(made.limit(1)), str(tmp_path / "u"), ["name"], ["cv", "cvset"], dealt=True)
