"""Golden cases of the pose library."""

import random

import pytest
from pyspark.sql import functions as F

from skein import functions as X
from skein.operators import atoms as A
from skein.operators import poses as P
from skein.operators import tables as T
from skein.plans import similarity as S
from skein.plans.graph import label_vertices, spanning_forest
from skein.plans.split import Quotas, clusters, cv_split, leaks, recut, sample_compounds, split_and_record

SCORES = "gene string, compound string, model_name string, pose_id string, distance double, energy_kcal double, kdmodel double"


def test_pick_pose_ties_nulls_and_fallback(spark):
    rows = [
        ("g", "near", "M1", "1", 10.0, -5.0, 1.0),
        ("g", "near", "M2", "1", 9.0, -5.0, 1.0),
        ("g", "near", "M3", "1", 1.0, -4.0, None),
        ("g", "near", "M0", "1", 10.1, -9.0, 0.0),
        ("g", "far", "M2", "2", 30.0, -1.0, None),
        ("g", "far", "M1", "2", 20.0, -1.0, None),
        ("g", "none", "M1", "2", None, None, None),
    ]
    out = {r.compound: r for r in P.pick_pose(spark.createDataFrame(rows, SCORES)).collect()}
    assert out["near"].model_name == "M1" and not out["near"].fallback and out["near"].rank_avg == 1
    assert out["far"].model_name == "M1" and out["far"].fallback
    assert out["none"].rank_avg is None


def test_bands_and_heavy_atoms(spark):
    d = spark.createDataFrame([(10.0, "H"), (10.1, "H.1"), (20.0, "Hg"), (20.1, "C.3"), (None, "N")], "d double, t string")
    rows = d.select(X.band(F.col("d")), X.heavy(F.col("t")), X.heavy(F.col("t"), "typed")).collect()
    assert [r[0] for r in rows] == [None, "medium", None, "high", None]
    assert [r[1] for r in rows] == [False, False, False, True, True] and [r[2] for r in rows] == [True, False, False, True, True]


def test_pick_negative_switches_bands(spark):
    wish = "gene string, compound string, dataset string, dist_bin string"
    wishes = spark.createDataFrame([("g", "a", "KD", "medium"), ("g", "b", "KI", "high"), ("g", "c", "KI", "high"), ("g", "a", "KI", None), ("g", "a", "X", "high")], wish)
    poses = spark.createDataFrame([("g", "a", "M", "1", 25.0), ("g", "b", "M", "1", 25.0), ("g", "b", "M", "2", 15.0), ("g", "c", "M", "1", 20.0)], "gene string, compound string, model_name string, pose_id string, distance double")
    out = {r.compound: (r.dataset, r.dist_bin, r.expt, r.pose_id) for r in P.pick_negative(wishes, poses).collect()}
    assert out == {"a": ("NEG1", "high", 3.2, "1"), "b": ("NEG2", "high", 3.2, "1"), "c": ("NEG2", "high", 3.2, None)}


def test_wishes_that_cant_be_served_are_listed(spark):
    wishes = spark.createDataFrame([("g", "a", "KD", "medium"), ("g", "b", "KI", None), ("g", "c", "KI", "low"), ("g", "d", "X", "high"), ("g", "e", None, "medium"), ("g", "f", "X", "low")], "gene string, compound string, dataset string, dist_bin string")
    assert {r.compound: r.reject_reason for r in P.negative_rejects(wishes).collect()} == {"c": "unknown band", "d": "unknown dataset", "e": "unknown dataset", "f": "unknown band"}


@pytest.mark.parametrize(("n", "total"), [(1, 5), (3, 5), (5, 5), (8, 5)])
def test_run_allocation_spends_the_budget(spark, n, total):
    models = spark.createDataFrame([("d", f"m{i}") for i in range(n)], "domain string, model_name string")
    runs = [r.runs for r in P.run_allocation(models, 5).collect()]
    assert sum(runs) == total and max(runs) - min(runs) <= 1


def test_atoms_with_fused_columns(spark):
    line = "ATOM     12  NH2 ARG A  67    -123.456-999.1251000.500"
    lines = spark.createDataFrame([("f", 1, line), ("f", 2, "TER"), ("f", 3, line)], "file string, ord int, value string")
    a = A.parse_atoms(A.lines_before(lines, F.col("value").startswith("TER"))).collect()
    assert len(a) == 1 and (a[0].serial, a[0].atom, a[0].x, a[0].y, a[0].z) == (12, "NH2", -123.456, -999.125, 1000.5)


def test_rotations_are_the_cube_group():
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    found = A.rotations()
    assert len(set(found)) == 24 and all(det(m) == 1 for m in found) and found[0] == (1, 0, 0, 0, 1, 0, 0, 0, 1)
    turned = lambda v, m: tuple(sum(v[i] * m[3 * i + j] for i in range(3)) for j in range(3))
    # Then a quarter turn about x (y goes to z), and the half turn about (1, 1, 0), which is the eleventh.
    assert turned((0, 1, 0), found[1]) == (0, 0, 1) and turned((1, 0, 0), found[7]) == (0, 1, 0) and turned((1, 2, 3), found[10]) == (2, 1, -3)
    assert turned((1, 2, 3), found[16]) == (3, 1, 2)  # a third turn about (1, 1, 1)


def test_voxels_round_half_to_even_and_stay_in_the_box(spark):
    atoms = spark.createDataFrame([(1, x, 0.0, 0.0) for x in (-10.5, -10.6, 0.5, 1.5, 10.4, 10.6)], "complex_id int, x double, y double, z double")
    out = A.voxel_index(A.rotate(atoms, 1)).collect()
    assert sorted(r.ix for r in out) == [0, 10, 12, 20]


def test_custom_scorer_sees_each_complex(spark):
    atoms = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (2, 0.0, 2.0, 0.0)], "complex_id long, x double, y double, z double")
    grid = A.voxelize(atoms, {"n": F.lit(1.0)}, n=2)
    assert {r.complex_id: r.score for r in A.score_with(grid, lambda: lambda pdf: pdf["n"]).collect()} == {1: 1.0, 2: 2.0}


@pytest.mark.parametrize(("batch", "arrow"), [(1, 10_000), (5, 7), (500, 10_000)])
def test_batches_of_dense_grids(spark, batch, arrow):
    """Batches smaller and larger than the Arrow runs; complexes that end and begin within either; a scorer that sees the cells."""
    rng = random.Random(7)
    rows = [(i, rng.uniform(-10, 10), rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(13) for _ in range(rng.randrange(1, 9))] + [(None, 0.0, 0.0, 0.0), (99, 80.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "complex_id long, x double, y double, z double").repartition(3)
    grid = A.voxelize(atoms, {"n": F.lit(1.0), "w": F.col("rx")}, n=4).cache()

    def load():
        def scorer(cells):
            assert cells.ndim == 5 and 1 <= len(cells) <= batch and cells.shape[1:] == (21, 21, 21, 2)
            return [(c[..., 1] * c[..., 0]).sum() + c[3].sum() for c in cells]

        return scorer

    want = {}
    for r in grid.collect():
        want.setdefault((r.complex_id, r.rotation), 0.0)
        want[r.complex_id, r.rotation] += r.n * r.w + (r.n + r.w if r.ix == 3 else 0.0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = {r.complex_id: r.score for r in A.score_batches(grid, ["n", "w"], load, batch, dtype="float64").collect()}
        empty = A.score_batches(grid.limit(0), ["n", "w"], load, batch).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i in range(13):
        own = [s for (c, _), s in want.items() if c == i]
        assert got[i] == pytest.approx(sum(own) / len(own))
    assert set(got) == {c for c, _ in want if c is not None} and empty == []


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)] + [(7, 7), (None, 3)]
    root = {v: v for v in range(300)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in label_vertices(spark.range(300), df).collect()}
    assert got == {v: find(v) for v in range(300)}
    assert label_vertices(spark.range(3), df.limit(0)).count() == 3


def _linked(vertices, edges, limit):
    """Smallest member of each vertex's component of the edges up to ``limit``."""
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b, dist in edges:
        if a in root and b in root and dist is not None and dist <= limit:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_threshold_is_a_cut_of_one_forest(spark, seed):
    """Random graphs with few different lengths, so with very many ties, doubled edges, loops and nulls."""
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(6) / 10) for _ in range(110)] + [(3, 3, 0.0), (None, 1, 0.1), (2, 5, None)] + [(100 + i, 101 + i, 0.3) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long, dist double")
    forest = spanning_forest(df).cache()
    vertices = list(range(40)) + list(range(100, 131))
    nodes = spark.createDataFrame([(v,) for v in vertices], "v long")
    whole = _linked(vertices, [e for e in edges if e[0] is not None], 9)
    assert forest.count() == len(vertices) - len(set(whole.values()))
    for limit in (0.0, 0.2, 0.3, 0.5):
        want = _linked(vertices, [e for e in edges if e[0] is not None], limit)
        assert {r.v: r.cluster for r in clusters(nodes, forest, limit, "v").collect()} == want
    assert {r.dist for r in spanning_forest(df, 0.2).collect()} <= {0.0, 0.1, 0.2}
    assert spanning_forest(df.limit(0)).collect() == []


def test_clusters_of_what_is_left_are_cut_anew(spark):
    """A chain that loses its middle falls apart, a cluster that loses an end stays, one that loses all goes."""
    edges = [(f"a{i}", f"a{i + 1}", 0.1) for i in range(6)] + [("b0", "b1", 0.1), ("c0", "c1", 0.1)]
    vertices = sorted({x for e in edges for x in e[:2]} | {"d"})
    left = [v for v in vertices if v not in ("a3", "b1", "c0", "c1")]
    e = spark.createDataFrame(edges, "a string, b string, dist double")
    of = clusters(spark.createDataFrame([(v,) for v in vertices], "v string"), e, 0.2, "v")
    got = recut(of, spark.createDataFrame([(v, 1) for v in left] * 2, "v string, n int"), e, 0.2, "v")
    assert {r.v: r.cluster for r in got.collect()} == _linked(left, edges, 0.2)
    assert {r.v for r in recut(of, spark.createDataFrame([(v,) for v in vertices], "v string"), e, 0.2, "v").collect()} == set(vertices)


def test_a_compound_is_drawn_before_its_gene(spark):
    """A cluster of a compound with nine genes and one with a single gene: each is drawn about half the time."""
    pool = spark.createDataFrame([(f"g{i}", "A", "low") for i in range(9)] + [("g0", "B", "low")] + [(f"g{i}", f"x{i}", "low") for i in range(3)], "gene string, compound string, subset string")
    of = pool.select("compound", F.when(F.col("compound").isin("A", "B"), "A").otherwise(F.col("compound")).alias("cluster")).distinct().cache()
    degrees = pool.select("compound", F.when(F.col("compound") == "B", 0).otherwise(1).alias("num")).distinct().cache()
    seen = [sample_compounds(pool, pool, of, degrees, Quotas({"low": 3}), 100, seed)[0].where("cluster = 'A'").collect() for seed in range(16)]
    drawn = [r[0].compound for r in seen if r]
    assert len(drawn) >= 6 and 0.2 <= drawn.count("A") / len(drawn) <= 0.8


@pytest.mark.parametrize("postings", [2048, 3])
@pytest.mark.parametrize("limit", [0.0, 0.2, 0.5, 0.8])
def test_jaccard_join_loses_no_pair(spark, limit, postings, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", postings)
    rng = random.Random(4)
    sets = [(f"c{i}", sorted(rng.sample(range(200), rng.randrange(0, 9)))) for i in range(120)]
    sets += [(f"d{i}", s) for i, (_, s) in enumerate(sets[:10])]
    rows = S.jaccard_pairs(spark.createDataFrame(sets, "compound string, bits array<int>"), limit).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(got) == len(rows)
    want = set()
    for a, x in sets:
        for b, y in sets:
            u = len({*x} | {*y})
            if a < b and x and y and u - len({*x} & {*y}) <= limit * u + 1e-12:
                want.add((a, b))
    empty = sorted(a for a, x in sets if not x)
    assert got == want | {(empty[0], b) for b in empty[1:]}


def test_quotas_carry_small_shortages():
    subsets = ["xtal", "nonbind", "high", "low"]
    q = Quotas(dict.fromkeys(subsets, 5))
    assert [q.meet("xtal", 5), q.meet("nonbind", 0), q.meet("high", 2)] == [5, 0, 2] and q.wanted("low") == 13
    assert q.meet("low", 13) is None  # as many as wanted are too few for low,
    assert Quotas({"low": 13}).meet("low", 14) == 13 and Quotas({"low": 13}).meet("low", 13, exact=True) == 13  # but for random pairs
    assert Quotas({"xtal": 5}).meet("xtal", 1) is None and Quotas({"low": 5}).meet("low", 4, exact=True) is None
    q = Quotas({"xtal": 5, "low": 5})
    assert q.meet("xtal", 9) == 5 and q.keep("xtal", 3) == 3 and q.wanted("low") == 7
    assert Quotas({"xtal": 5}).keep("xtal", 0) is None and Quotas({"low": 5}).keep("low", 4) is None


def _sampled(spark, sizes, want, limit=1000, used=0):
    """Pairs sampled from compound clusters of the given sizes (one compound each, with a gene for each pair)."""
    rows = [(f"g{j}", f"c{i:02d}", "high") for i, n in enumerate(sizes) for j in range(n)]
    rows += [(f"g{j}", f"c{i:02d}", "xtal") for i in range(used) for j in range(sizes[i])]
    rows += [("g0", f"l{i}", "low") for i in range(30)]
    pool = spark.createDataFrame(rows, "gene string, compound string, subset string")
    of = pool.select("compound", F.col("compound").alias("cluster")).distinct()
    degrees = spark.createDataFrame([(f"c{i:02d}", n) for i, n in enumerate(sizes)] + [(f"l{i}", 1) for i in range(30)], "compound string, num long")
    got, failed = sample_compounds(pool, pool, of, degrees, Quotas({"xtal": used, "nonbind": 0, "high": want, "low": 2}), limit, 1)
    out = {}
    for r in got.collect():
        out.setdefault(r.subset, set()).add(r.cluster)
    return out, failed


def test_compounds_are_sampled_below_the_soft_cut_off(spark):
    # Six clusters and a quota of two: element max(1, round(6 / 2)) = 3 of the sizes is 4, so four clusters are left to draw from.
    out, failed = _sampled(spark, [1, 2, 3, 4, 5, 6], 4)
    assert failed is None and out["high"] == {"c00", "c01", "c02", "c03"}
    # A quota above half of them moves the cut-off to element quota - 1 instead.
    out, failed = _sampled(spark, [1, 2, 3, 4, 5, 6], 5)
    assert failed is None and out["high"] == {"c00", "c01", "c02", "c03", "c04"}
    # The size limit is below it: two clusters are left, and a shortage of three goes to low.
    out, failed = _sampled(spark, [1, 2, 3, 4, 5, 6], 5, limit=2)
    assert failed is None and out["high"] == {"c00", "c01"} and len(out["low"]) == 5
    # Clusters used before count for the cut-off and go afterwards.
    out, failed = _sampled(spark, [1, 2, 3, 4, 5, 6], 4, used=2)
    assert failed is None and out["xtal"] == {"c00", "c01"} and out["high"] == {"c02", "c03"} and len(out["low"]) == 4
    assert _sampled(spark, [1, 2, 3, 4, 5, 6], 6, limit=1)[1] == "high"


def test_split_sets_are_disjoint_and_leak_nothing(spark):
    rng = random.Random(8)
    rows = [(f"g{g}", f"c{c}", rng.choice(["high", "low", "low", "nonbind", "xtal"])) for g in range(40) for c in range(120) if rng.random() < 0.15]
    pool = spark.createDataFrame(rows, "gene string, compound string, subset string")
    gene_edges = spark.createDataFrame([(f"g{2 * i}", f"g{2 * i + 1}", 5.0 + i) for i in range(20)], "a string, b string, dist double")
    compound_edges = spark.createDataFrame([(f"c{3 * i}", f"c{3 * i + 1}", 0.1 + i / 100) for i in range(40)], "a string, b string, dist double")
    docked = spark.createDataFrame([(f"g{i}",) for i in range(30)], "gene string")
    quota = {"xtal": 1, "nonbind": 1, "high": 1, "low": 2}
    split = cv_split(pool, gene_edges, compound_edges, docked, [10.0, "random"], [0.2, "random"], quota, 10_000, random_clusters={"docked": 5, "xtal": 3})
    found = split.collect()
    sets = [r for r in found if r.cvset != "training" and r.compound]
    pairs = [(r.gene, r.compound) for r in found if r.compound]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= {r[:2] for r in rows}
    cells = {(r.kthresh, r.cvset, r.atype, r.cthresh) for r in sets}
    assert {c[0] for c in cells} == {"10.0", "random"} and {c[3] for c in cells} == {"0.2", "random"}
    for cell in cells:
        assert sum((r.kthresh, r.cvset, r.atype, r.cthresh) == cell for r in sets) == 5
    assert {r[2] for r in rows for s in sets if s.atype == "xtal" and r[:2] == (s.gene, s.compound)} <= {"xtal"}
    assert leaks(split, compound_edges, "compound", "cthresh").count() == 0 and leaks(split, gene_edges, "gene", "kthresh").count() == 0
    few = cv_split(pool, gene_edges, compound_edges, docked, [10.0], [0.2], {"low": 500}, 10_000, retries={"docked": 1, "xtal": 1}).where("status <> 'ok'").collect()
    assert {(r.atype, r.cvset) for r in few} == {("docked", "validation"), ("xtal", "validation")} and all(r.compound is None and "low" in r.status for r in few)


def test_later_thresholds_see_only_what_is_left(spark):
    """Two gene and two compound thresholds: each cell's pairs lie in clusters of what earlier cells left, and the record holds their other members."""
    rng = random.Random(5)
    rows = [(f"g{g}", f"c{c}", rng.choice(["high", "low", "low", "nonbind", "xtal"])) for g in range(60) for c in range(160) if rng.random() < 0.15]
    gene_edges = [(f"g{i}", f"g{i + 1}", rng.choice([4.0, 8.0, 30.0])) for i in range(59)]
    compound_edges = [(f"c{i}", f"c{i + 1}", rng.choice([0.1, 0.3, 0.9, 0.9])) for i in range(159)]
    frame = lambda x, s: spark.createDataFrame(x, s)
    docked = frame([(f"g{i}",) for i in range(60)], "gene string")
    quota = {"xtal": 1, "nonbind": 1, "high": 1, "low": 2}
    split, record = split_and_record(frame(rows, "gene string, compound string, subset string"), frame(gene_edges, "a string, b string, dist double"), frame(compound_edges, "a string, b string, dist double"), docked, [5.0, 10.0], [0.4, 0.2], quota, 10_000)
    sets = [r for r in split.collect() if r.compound]
    training, members = [r for r in sets if r.cvset == "training"], record.collect()
    left, cells = {r[:2] for r in rows}, 0
    for k in ("5.0", "10.0"):
        genes = _linked({g for g, _ in left}, gene_edges, float(k))
        for cvset in ("validation", "test"):
            own = [r for r in sets if (r.kthresh, r.cvset, r.atype) == (k, cvset, "docked")]
            for c in ("0.4", "0.2"):
                compounds = _linked({x for _, x in left}, compound_edges, float(c))
                cell = [r for r in own if r.cthresh == c]
                if not cell:
                    continue
                cells += 1
                assert {(r.gene, r.compound) for r in cell} <= left and len(cell) == 5
                used = {compounds[r.compound] for r in cell}
                assert len(used) == len(cell)  # one pair a cluster of what was left then
                beside = [r for r in members if (r.kthresh, r.cvset, r.atype, r.cthresh) == (k, cvset, "docked", c)]
                assert {compounds[r.compound] for r in beside} <= used and {r.cluster for r in beside} <= used
                assert not {(r.gene, r.compound) for r in beside} & {(r.gene, r.compound) for r in cell}
                left = {p for p in left if compounds[p[1]] not in used}
            gone = {genes[r.gene] for r in own}
            left = {p for p in left if genes[p[0]] not in gone}
    assert cells == 8 and left == {(r.gene, r.compound) for r in training} and members


@pytest.mark.parametrize("parts", [1, 7])
def test_minibatches_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).repartition(parts)
    got = T.minibatches(df, "id", 0, 1, 30)
    assert {r[0]: r[1] for r in got.groupBy("batch").count().collect()} == {i: 30 for i in range(33)} | {33: 10}
    assert got.agg(F.sum(F.col("id") * F.col("batch"))).first()[0] == T.minibatches(spark.range(1000), "id", 0, 1, 30).agg(F.sum(F.col("id") * F.col("batch"))).first()[0]


@pytest.mark.parametrize("parts", ["1", "5"])
def test_prefix_sums_of_ordered_rows(spark, parts):
    """Numbers and totals as a plain loop has them, over as many ranges as there are partitions."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([0, 1, 5, None])) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "id long, row_name string, w int").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = T.prefix_sums(df, ["id"], {"total": F.col("w"), "xs": (F.col("row_name") == "x").cast("int")}).collect()
        ranges = T.pending_batches(df, ["id"], F.coalesce(F.col("w") > 0, F.lit(False)), 40).orderBy("batch").collect()
        none = T.prefix_sums(df.limit(0), ["id"], {"total": F.col("w")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, total, xs = [], 0, 0
    for n, (i, name, w) in enumerate(sorted(rows)):
        total, xs = total + (w or 0), xs + (name == "x")
        want.append((i, name, w, n, total, xs))
    assert sorted(tuple(r) for r in got) == want and none == []
    assert [r.start for r in ranges] == [0, *(r.end for r in ranges[:-1])] and ranges[-1].end == 700
    assert [r.n_pending for r in ranges[:-1]] == [40] * (len(ranges) - 1)


def test_folds_as_a_table_and_as_columns_are_the_same(spark):
    rows = [(str(i % 5), str(i), "M1", f"1-{i}", "KD" if i % 2 else "KI", float(i)) for i in range(40)]
    picks = spark.createDataFrame(rows, "gene string, compound string, model_name string, pose_id string, dataset string, expt double")
    of = {k: F.when(F.col("expt") % (k + 2) == 0, "test").when(F.col("expt") % 5 != k, "training") for k in (1, 2)}
    table = picks.select("gene", "compound", "dataset", F.explode(F.array(*[F.struct(F.lit(k).alias("cv"), c.alias("cvset")) for k, c in of.items()])).alias("f")).select("gene", "compound", "dataset", "f.*").where("cvset IS NOT NULL")
    parts = picks.where("expt < 20"), picks.where("expt >= 20").drop("expt").withColumn("expt", F.col("compound").cast("double"))
    one, other = (P.training_picks(*parts, f) for f in (table, of))
    assert sorted(map(repr, one.select(sorted(one.columns)).collect())) == sorted(map(repr, other.select(sorted(one.columns)).collect()))
    used, _ = P.cv_fanout(other)
    assert used.count() == table.count()
    atoms = spark.createDataFrame([("M1", f"1-{i}", o, "C.3", float(i), 0.0, float(o)) for i in range(40) if i != 2 for o in (2, 1)], "model_name string, pose_id string, ord int, atom_type string, x double, y double, z double")
    receptors = spark.createDataFrame([("M1", 1, "C.3", 1.0, 2.0, 3.0)], "model_name string, ord int, atom_type string, x double, y double, z double")
    made = {(r.name, r.cv): r for r in P.training_complexes(used, atoms, receptors).collect()}
    assert len(made) == used.count() and {r.reject_reason for (n, _), r in made.items() if n == "2|2_KI"} == {"no pose"}
    a = made["3|3_KD", 1]
    assert [(x.ord, x.x, x.z) for x in a.ligand] == [(1, 0.0, -0.5), (2, 0.0, 0.5)] and [(x.x, x.y, x.z) for x in a.receptor] == [(-2.0, 2.0, 1.5)] and a.reject_reason is None
