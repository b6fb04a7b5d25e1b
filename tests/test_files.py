"""Readers and writers against hand-made files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import atoms as A
from skein.operators import poses as P
from skein.operators import tables as T
from skein.plans import similarity as S
from skein.functions import archive_stem, parse_name, parse_target
from skein.sources import files, matrices, scratch


def test_csv_keeps_ids_as_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text("compound,gene,value,is_kinase,other\nK1,007,NaN,true,x\nK2,12e3,1.5,False,y\n")
    rows = files.read_table(spark, str(tmp_path / "p.csv")).orderBy("compound").collect()
    assert [(r.gene, r.value, r.is_kinase, r.smiles) for r in rows] == [("007", None, True, None), ("12e3", 1.5, False, None)]


def test_score_files_are_one_table(spark, tmp_path):
    for gene, compound, body in (("5", "AB", "M1,1-1,2.5\nM2,1-2,3\n"), ("5", "CD", ""), ("006", "AB", "M1,9-1,7\n")):
        (tmp_path / gene).mkdir(exist_ok=True)
        (tmp_path / gene / f"{compound}_rmsd.csv").write_text("modelname,poseID,distance\n" + body)
    (tmp_path / "5" / "EF_rmsd.csv").write_text("")
    got = files.read_pair_scores(spark, str(tmp_path), files.SCORES["distance"])
    assert sorted(tuple(r) for r in got.collect()) == [("006", "AB", "M1", "9-1", 7.0), ("5", "AB", "M1", "1-1", 2.5), ("5", "AB", "M2", "1-2", 3.0)]
    pairs = spark.createDataFrame([("5", "AB"), ("5", "CD"), ("5", "EF"), ("006", "AB")], "gene string, compound string")
    assert sorted(r.compound for r in T.missing(pairs, got, ["gene", "compound"]).collect()) == ["CD", "EF"]


def test_text_files(spark, tmp_path):
    (tmp_path / "index").write_text("# head\n#\n#\n#\n#\n1abc  2.0  1999 6.4  Kd=1 // x.pdf (LIG)\n# gone\n2xyz NMR 2001 5.1 Ki=2 // y.pdf (AB)")
    got = files.read_index(spark, str(tmp_path / "index"), {"code": 0, "year": 2, "ligand": 7}).collect()
    assert [tuple(r) for r in got] == [("1abc", "1999", "(LIG)"), ("2xyz", "2001", "(AB)")]
    (tmp_path / "list").write_text("12|AAAA-N\n007|BBBB-N")
    assert [tuple(r) for r in files.read_pair_list(spark, str(tmp_path / "list")).collect()] == [("12", "AAAA-N"), ("007", "BBBB-N")]
    (tmp_path / "t.fa").write_text(">AB_HUMAN_D0\nACDE\nFG\n>CD_HUMAN_D0\nAC")
    assert [r.target for r in files.read_targets(spark, str(tmp_path / "t.fa")).collect()] == ["AB_HUMAN_D0", "CD_HUMAN_D0"]
    (tmp_path / "X_D0_sequence-identities.txt").write_text("M1 45.5\nM2 30\n")
    (tmp_path / "X_D0_0.1_unique-models.txt").write_text("M1\nM2\nM3\n")
    models, identities = files.read_models(spark, str(tmp_path / "*unique-models.txt")), files.read_identities(spark, str(tmp_path / "*identities.txt"))
    found, none = P.with_identity(models, identities)
    assert sorted(tuple(r) for r in found.collect()) == [("X_D0", "M1", 45.5), ("X_D0", "M2", 30.0)] and [r.model_name for r in none.collect()] == ["M3"]
    (tmp_path / "a.txt").write_text("/12/ABC-N.zip\n/12_prot_PDB.zip\n")
    assert sorted((tuple(r) for r in files.read_archive(spark, str(tmp_path / "a.txt")).collect()), key=repr) == [("12", "ABC-N", "compound"), ("12", None, "protein")]
    (tmp_path / "s.pdb").write_text("ATOM      1  N   MET A   1      11.000  12.000  13.000\r\nTER\r\n")
    lines = files.read_lines(spark, str(tmp_path / "s.pdb"))
    assert [r.ord for r in lines.collect()] == [1, 2] and A.parse_atoms(lines).first().z == 13.0


def test_keyed_tables_refuse_a_second_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")], "name string, cv int, v string")
    path = str(tmp_path / "out")
    files.write_keyed(rows, path, ["name"], ["cv"])
    more = spark.createDataFrame([("c", 1, "z")], "name string, cv int, v string")
    files.write_keyed(more, path, ["name"], ["cv"], "append")
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.write_keyed(more, path, ["name"], ["cv"], "append")
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.write_keyed(rows.union(rows), str(tmp_path / "none"), ["name"], ["cv"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("name", "cv", "v").collect()) == [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("c", 1, "z")]
    assert not (tmp_path / "none").exists()


def test_keyed_files_have_a_limit_and_null_keys_are_keys(spark, tmp_path):
    """A value with nine tenths of all rows goes to many files; an append meets a null key and a null folder."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("cv"))
    files.write_keyed(rows, path := str(tmp_path / "out"), ["name"], ["cv"], rows=50)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 50
    kind = "name string, cv int"
    odd = spark.createDataFrame([(None, 1), ("x", None)], kind)
    files.write_keyed(odd, path, ["name"], ["cv"], "append")
    for row in odd.collect():
        with pytest.raises(ValueError, match="occurs 2 times"):
            files.write_keyed(spark.createDataFrame([row, ("y", 3)], kind), path, ["name"], ["cv"], "append")
    files.write_keyed(rows.where("false"), path, ["name"], ["cv"], "append")
    assert spark.read.parquet(path).count() == 1002


@pytest.mark.parametrize("split", [3000, 1 << 20])
def test_matrix_archives_round_trip(spark, tmp_path, split):
    """Archives of any size read in ranges of bytes; names with separators, missing affinities, matrices without rows."""
    rng = random.Random(split)
    want = {f"{i}|K/{i % 3}_KD": ([[rng.random() for _ in range(5)] for _ in range(i % 4)], None if i % 7 == 0 else i / 2) for i in range(60)}
    df = spark.createDataFrame([(k, *v) for k, v in want.items()], "name string, data array<array<double>>, affinity double").repartition(3)
    path = str(tmp_path / "m")
    first = F.xxhash64("name") % 2 == 0
    matrices.write_matrices(df.where(first), path, split=split)
    matrices.write_matrices(df.where(~first), path, split=split)
    (tmp_path / "m" / "_left.npz").write_bytes(b"half")
    got = {r.name: (r.data, r.affinity) for r in matrices.read_matrices(spark, path, split).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and len(got[k][0]) == len(want[k][0]) and np.allclose(got[k][0] or [], want[k][0] or []) for k in want)
    one = next(f for f in sorted((tmp_path / "m").glob("*.npz")) if f.name[0] != "_")
    with np.load(one) as archive:
        assert all(np.allclose(archive[n], want[n[:-5]][0] or np.zeros((0, 0))) for n in archive.files if n.endswith("/data"))
    assert matrices.read_matrices(spark, str(one)).count() <= 60
    before = sorted((tmp_path / "m").iterdir())
    with pytest.raises(ValueError, match="occurs 2 times"):
        matrices.write_matrices(df.limit(1), path)
    for bad in ([(None, [[1.0]], 1.0)], [("n", None, 1.0)], [("n", [[1.0], [1.0, 2.0]], 1.0)]):
        with pytest.raises(Exception, match="a matrix"):
            matrices.write_matrices(spark.createDataFrame(bad, df.schema), path)
    assert [f for f in sorted((tmp_path / "m").iterdir()) if f.name[0] != "_"] == [f for f in before if f.name[0] != "_"]
    matrices.write_matrices(df.where("false"), str(tmp_path / "none"))
    assert matrices.read_matrices(spark, str(tmp_path / "none")).count() == 0
    matrices.write_matrices(df.limit(5), path, "overwrite")
    assert matrices.read_matrices(spark, path).count() == 5


def test_text_of_poses_is_scored_and_scored_again(spark):
    """Whole texts in the order of their lines reach the scorer; a second one gets what the first gave no energy for."""
    atom = "ATOM      1  C   UNL     1      00.000  00.000  00.000  1.00"
    lines = [(f, o, v) for f in ("a", "b", "c", "d", "e", None) for o, v in ((3, "END"), (1, f"REMARK {f}"), (2, None if f == "e" else atom))]
    atoms = [(f, 1, 1.5, -22.25, 333.125) for f in "abd"]
    spliced = A.splice_pose_lines(spark.createDataFrame(lines, "file string, ord int, value string"), spark.createDataFrame(atoms, "file string, ord int, x double, y double, z double"))

    def first():
        def run(texts):
            assert len(texts) <= 2 and all(t.split("\n")[0].startswith("REMARK") and t.endswith("END") for t in texts)
            return [f"x\n Affinity: {float(t.split(chr(10))[1][38:46])} (kcal/mol)" if "REMARK a" in t else None if "REMARK b" in t else "no" for t in texts]

        return run

    again = lambda: lambda texts: ["Affinity: none" if "REMARK b" in t else "Affinity: -3.5\nAffinity: 7" if "REMARK d" in t else None for t in texts]
    got = {r.file: (r.attempt, r.energy, r.reject_reason) for r in A.score_text(spliced, [first, again], 2).collect()}
    assert got == {"a": (1, -22.25, None), "b": (2, None, "no energy"), "c": (None, None, "pose_error"), "d": (2, -3.5, None), "e": (2, None, "no output"), None: (None, None, "pose_error")}
    assert A.score_text(spliced.where("false"), [first], 2).count() == 0


def test_distances_are_looked_up(spark):
    edges = spark.createDataFrame([("b", "a", 3.0), ("a", "b", 2.0), ("a", "a", 5.0)], "a string, b string, dist double")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("b", "b", 3), ("a", "z", 4), (None, "a", 5), ("a", "a", 6)], "a string, b string, n int")
    assert {r.n: r.dist for r in S.distances_of(pairs, edges).collect()} == {1: 2.0, 2: 2.0, 3: 0.0, 4: 100.0, 5: 100.0, 6: 5.0}
    whole = {(r.a, r.b): r.dist for r in S.complete(spark.createDataFrame([("a",), ("b",), ("c",)], "g string"), edges).collect()}
    assert len(whole) == 9 and whole["b", "a"] == 2.0 and whole["c", "c"] == 0.0 and whole["a", "c"] == 100.0


def test_names_and_targets_come_apart(spark):
    names = spark.createDataFrame([("12|ABC-N_KD",), ("007|X_KI_2",), ("12",), ("",), (None,)], "n string").select(parse_name(F.col("n")).alias("p"))
    assert [tuple(r.p) for r in names.collect()] == [("12", "ABC-N", "KD"), ("007", "X", "KI"), ("12", None, None), (None, None, None), (None, None, None)]
    targets = spark.createDataFrame([("AB_HUMAN_D0",), ("AB_HUMAN_2",), ("AB_HUMAN",), ("A_D1_HUMAN_D12",), (None,)], "t string").select(parse_target(F.col("t")).alias("p"))
    assert [tuple(r.p) for r in targets.collect()] == [("AB_HUMAN", 0), ("AB_HUMAN", 1), ("AB_HUMAN", None), ("A_D1_HUMAN", 12), (None, None)]
    stems = spark.createDataFrame([("/12/ABC-N.zip",), ("ABC.zip",), ("a.zip.b",), ("",)], "f string").select(archive_stem(F.col("f")).alias("s"))
    assert [r.s for r in stems.collect()] == ["ABC-N", "ABC", "a.zip.b", ""]


def test_pose_text_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("p", 1, "REMARK"), ("p", 2, "ATOM      1  C   UNL     1      00.000  00.000  00.000  1.00"), ("p", 3, ""), ("q", 1, "ATOM " + " " * 60)], "file string, ord int, value string")
    atoms = spark.createDataFrame([("p", 1, 1.5, -22.25, 333.125), ("q", 1, 0.0, 0.0, 0.0)], "file string, ord int, x double, y double, z double")
    spliced = A.splice_pose_lines(lines, atoms)
    files.write_pose_text(spliced, str(tmp_path / "out"))
    got = sorted(tuple(r) for r in files.read_pose_text(spark, str(tmp_path / "out")).collect())
    assert got == sorted((r.file, r.ord, r.value) for r in spliced.collect())
    assert got[1][2] == f"{'ATOM      1  C   UNL     1':30}   1.500 -22.250 333.125  1.00"
    with pytest.raises(ValueError, match="more atom lines"):
        files.write_pose_text(A.splice_pose_lines(lines, atoms.where("file = 'q'")), str(tmp_path / "bad"))


def test_matrix_rows_and_matrices(spark):
    d = spark.createDataFrame([("n", [[1.0, 2.0, 3.0, 4.0, 5.0]] * 2)], "name string, data array<array<double>>")
    assert tuple(files.split_matrix(d).first()) == ("n", [[1.0, 2.0, 3.0]] * 2, [[4.0, 5.0]] * 2)


def test_backlog_is_what_has_no_output(spark):
    jobs = spark.createDataFrame([(i, str(i % 3)) for i in range(6)], "job long, gene string")
    outputs = spark.createDataFrame([(0,), (0,), (1,), (4,)], "job long")
    mapping = spark.createDataFrame([("0", "A"), ("1", "B")], "gene string, domain string")
    models = spark.createDataFrame([("A",)], "domain string")
    assert sorted(r.job for r in T.backlog(jobs, outputs, mapping, models, ["job"]).collect()) == [3]
    assert {r.job: r.n_done for r in T.unfinished(jobs, outputs, 2, ["job"]).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert [r.job for r in T.row_slice(jobs, ["job"], 2, 4).collect()] == [2, 3]


@pytest.mark.parametrize("limit", [0.0, 0.3, 0.6])
def test_dense_sets_are_compared_by_blocks(spark, limit, monkeypatch):
    """Few elements, each in half of the sets: both ways give the same pairs."""
    rng = random.Random(3)
    sets = [(i, sorted(e for e in range(100) if rng.random() < 0.5)) for i in range(150)] + [(200, []), (201, []), (202, [99])]
    sets += [(300 + i, s) for i, s in sets[:5]]
    df = spark.createDataFrame(sets, "compound int, bits array<int>")
    found = {(r.a, r.b): r.dist for r in S.jaccard_pairs(df, limit).collect()}
    want = {}
    for a, x in sets:
        for b, y in sets:
            inter, union = len({*x} & {*y}), len({*x} | {*y})
            if a < b and (union == 0 or x and y and union - inter <= limit * union + 1e-12):
                want[a, b] = 1 - inter / union if union else 0.0
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)


def test_lines_of_files_over_several_splits_keep_their_order(spark, tmp_path):
    """Two files of 3,000 lines in splits of 2 kB, one with carriage returns, one without a last line feed; an empty file has no lines."""
    lines = {"a": [f"a {i} " + "x" * (i % 50) for i in range(3000)], "b": ["" if i % 7 == 0 else f"b {i}" for i in range(3000)]}
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines["a"]).encode() + b"\r\n")
    (tmp_path / "b.txt").write_bytes("\n".join(lines["b"]).encode())
    (tmp_path / "c.txt").write_bytes(b"")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = files.read_lines(spark, f"{tmp_path}/*.txt")
        assert spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 20
        rows = found.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, own in lines.items():
        got = sorted((r.ord, r.value) for r in rows if r.file.endswith(f"/{name}.txt"))
        assert got == list(enumerate(own, 1))
    assert len(rows) == 6000


def test_tables_written_at_once_restore_the_setting(spark):
    """Two threads' writes overlap: the session's own setting comes back with the last, whatever it was."""
    for own in (None, "false"):
        spark.conf.unset(scratch.SHUFFLE_CLEANUP) if own is None else spark.conf.set(scratch.SHUFFLE_CLEANUP, own)
        before = spark.conf.get(scratch.SHUFFLE_CLEANUP, None)
        first, second = scratch.shuffle_cleanup(spark), scratch.shuffle_cleanup(spark)
        first.__enter__()
        second.__enter__()
        first.__exit__(None, None, None)
        assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == "true"
        second.__exit__(None, None, None)
        assert spark.conf.get(scratch.SHUFFLE_CLEANUP, None) == before
    spark.conf.unset(scratch.SHUFFLE_CLEANUP)
