"""Structure text and atom geometry: parsing, centres, distances, rotation, voxels, complexes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import heavy, substring_number, voxel

#: Columns (from 1) and widths of an ATOM record.
FIELDS = {"atom": (13, 4), "residue": (18, 3), "chain": (22, 1)}
XYZ = {"x": (31, 8), "y": (39, 8), "z": (47, 8)}


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atoms of ATOM lines, by fixed columns, so that fused coordinates come apart."""
    v = F.col("value")
    text = [F.trim(F.substring(v, *at)).alias(n) for n, at in FIELDS.items()]
    return lines.where(v.startswith("ATOM")).select("file", "ord", F.trim(F.substring(v, 7, 5)).try_cast("int").alias("serial"), *text, *[substring_number(v, *at).alias(n) for n, at in XYZ.items()])


def parse_energy(lines: DataFrame) -> DataFrame:
    """``file, energy`` of a scorer's output: the second word of the first line with ``Affinity``; null where there is none."""
    said = F.min_by("value", F.when(F.col("value").contains("Affinity"), F.col("ord")))
    return lines.groupBy("file").agg(said.alias("value")).select("file", F.get(F.split("value", r"\s+"), F.lit(1)).try_cast("double").alias("energy"))


#: What a scorer's line of its result holds.
SAID = "Affinity"


def score_text(spliced: DataFrame, attempts: list[Callable[[], Callable[[list[str]], list[str | None]]]], batch: int = 256) -> DataFrame:
    """``file, attempt, energy, reject_reason``: a caller's scorer over the text of whole poses, its output parsed.

    A pose is the lines of one ``file`` of ``splice_pose_lines``, joined in order. Each of
    ``attempts`` is run once a task and gives a function from up to ``batch`` texts to as many
    outputs (null: none); a pose whose output has no line with ``Affinity`` goes to the next
    attempt. ``attempt`` counts from 1 and is the last one made. Rejects by cause: ``pose_error``
    (atoms ran out; not scored), ``no output``, ``no energy``. A null line is an empty one.
    """
    kind = dict(spliced.dtypes)["file"]
    lines = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("value", F.lit("")).alias("value"))))
    poses = spliced.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("text"), F.max("short").alias("short"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [load() for load in attempts]
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b["text"].to_pylist()
                output, tried = [None] * len(texts), [None] * len(texts)
                left = [i for i, short in enumerate(b["short"].to_pylist()) if not short]
                for nth, score in enumerate(scorers, 1):
                    if left:
                        for i, said in zip(left, score([texts[i] for i in left]), strict=True):
                            output[i], tried[i] = said, nth
                        left = [i for i in left if SAID not in (output[i] or "")]
                yield pa.record_batch({"file": b["file"], "short": b["short"], "attempt": pa.array(tried, pa.int32()), "output": pa.array(output, pa.string())})

    out = poses.mapInArrow(run, f"file {kind}, short boolean, attempt int, output string")
    line = F.get(F.filter(F.split("output", "\n"), lambda x: x.contains(SAID)), F.lit(0))
    out = out.withColumn("energy", F.get(F.split(F.trim(line), r"\s+"), F.lit(1)).try_cast("double"))
    reason = F.when(F.col("short"), "pose_error").when(F.col("output").isNull(), "no output").when(F.col("energy").isNull(), "no energy")
    return out.select("file", "attempt", "energy", reason.alias("reject_reason"))


def markers(atoms: list[tuple[int, str, str, str]]) -> Column:
    """Number of the marker that a parsed atom is, by serial, name, residue and chain; null for others."""
    out = F.lit(None).cast("int")
    for i, (serial, atom, residue, chain) in enumerate(atoms):
        out = F.when((F.col("serial") == serial) & (F.col("atom") == atom) & (F.col("residue") == residue) & (F.col("chain") == chain), i).otherwise(out)
    return out


#: The active site's marker atoms in the reference structure.
SITE_MARKERS = [(865, "O", "MET", "A"), (515, "NH2", "ARG", "A")]


def splice_pose_lines(lines: DataFrame, atoms: DataFrame) -> DataFrame:
    """Template lines with the n-th atom line's coordinates replaced by the n-th atom's; ``short`` marks files whose atoms run out."""
    is_atom = F.col("value").contains("ATOM") | F.col("value").contains("UNL")
    w = Window.partitionBy("file").orderBy("ord")
    nth = F.when(is_atom, F.sum(is_atom.cast("int")).over(w))
    number = lambda c: F.lpad(F.format_string("%.3f", c), 8, " ")
    new = atoms.select("file", F.col("ord").alias("nth"), F.concat(*[number(F.col(f"{c}")) for c in "xyz"]).alias("new"))
    out = lines.withColumn("nth", nth).join(new, ["file", "nth"], "left")
    value = F.when(F.col("nth").isNotNull() & F.col("new").isNotNull(), F.concat(F.rpad(F.substring("value", 1, 30), 30, " "), "new", F.expr("substring(value, 55)"))).otherwise(F.col("value"))
    return out.select("file", "ord", value.alias("value"), (F.col("nth").isNotNull() & F.col("new").isNull()).alias("short"))


def lines_before(lines: DataFrame, marker: Column) -> DataFrame:
    """Lines of each file before its first marker line; all if it has none."""
    first = F.min(F.when(marker, F.col("ord"))).over(Window.partitionBy("file"))
    return lines.withColumn("first", first).where("first IS NULL OR ord < first").drop("first")


def keep_pocket_chains(atoms: DataFrame, pocket: DataFrame) -> DataFrame:
    """Atoms of chains that the pocket has."""
    return atoms.join(pocket.select("file", "chain").distinct(), ["file", "chain"], "left_semi")


def centroid(atoms: DataFrame, keys: list[str], mode: str = "any") -> DataFrame:
    """Mean of the heavy atoms of each key."""
    return atoms.where(heavy(F.col("atom_type"), mode)).groupBy(*keys).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])


def site_center(atoms: DataFrame, key: str, markers: Column, order: list[str]) -> DataFrame:
    """Mean of a receptor's marker atoms, the first of each marker."""
    first = atoms.withColumn("marker", markers).where("marker IS NOT NULL").groupBy(key, "marker").agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in "xyz"])
    return first.groupBy(key).agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])


def site_distance(centroids: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Distance from pose centroid to its receptor's site, three places."""
    d = F.sqrt(sum(((F.col(f"c{c}") - F.col(f"s{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return centroids.join(sites, key).withColumn("distance", F.round(d, 3))


def center(atoms: DataFrame, key: str, mode: str = "any") -> DataFrame:
    """Coordinates relative to the ligand's mean (molcode 1)."""
    w = Window.partitionBy(key)
    return atoms.withColumns({c: F.col(c) - F.avg(F.when(F.col("molcode") == 1, F.col(c))).over(w) for c in "xyz"})


def _turn(axis: tuple[int, int, int], angle: float) -> tuple[int, ...]:
    """Matrix, row by row, by which a row vector turns counter-clockwise about ``axis``."""
    n = math.sqrt(sum(v * v for v in axis))
    x, y, z = (v / n for v in axis)
    cross = ((0, -z, y), (z, 0, -x), (-y, x, 0))
    s, c = math.sin(angle), 1 - math.cos(angle)
    at = lambda i, j: (i == j) + s * cross[i][j] + c * sum(cross[i][k] * cross[k][j] for k in range(3))
    return tuple(round(at(j, i)) for i in range(3) for j in range(3))


def rotations() -> list[tuple[int, ...]]:
    """The 24 rotations of a cube: none; quarter turns about each axis; half turns about the face diagonals; third turns about the space diagonals."""
    unit = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    found = [_turn(unit[0], 0.0)]
    found += [_turn(axis, quarter * math.pi / 2) for axis in unit for quarter in (1, 2, 3)]
    for i, j in itertools.combinations(range(3), 2):
        found += [_turn(tuple((k == i) + sign * (k == j) for k in range(3)), math.pi) for sign in (1, -1)]
    diagonals = [(1, 1, 1), (-1, 1, 1), (1, -1, 1), (1, 1, -1)]
    return found + [_turn(axis, third * 2 * math.pi / 3) for third in (1, 2) for axis in diagonals]


def rotate(atoms: DataFrame, n: int = 24) -> DataFrame:
    """Each atom under the first ``n`` rotations: row vector times matrix, from a literal array, without a join."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in rotations()[:n]])
    out = atoms.select("*", F.posexplode(table).alias("rotation", "m"))
    at = lambda j: F.col("x") * F.col("m")[j] + F.col("y") * F.col("m")[3 + j] + F.col("z") * F.col("m")[6 + j]
    return out.withColumns({"rx": at(0), "ry": at(1), "rz": at(2)}).drop("m")


def reach_of(box: int, reach: float, spacing: float) -> float:
    """Atoms beyond this on any axis are in no voxel under any rotation."""
    return max(reach + spacing / 2, (box - 0.5) * spacing - reach)


def voxel_index(atoms: DataFrame, box: int = 21, reach: float = 10.0, spacing: float = 1.0) -> DataFrame:
    """Voxels ``ix, iy, iz`` of rotated atoms; atoms outside of the box are dropped."""
    out = atoms.withColumns({f"i{c}": voxel(F.col(f"r{c}"), reach, spacing) for c in "xyz"})
    return out.where(F.col("ix").between(0, box - 1) & F.col("iy").between(0, box - 1) & F.col("iz").between(0, box - 1))


#: Atoms of a task of ``voxelize``, about; each is in 24 rotations.
DEALT = 50_000
#: Atoms of a task that rotates a batch at a time, about.
STREAMED = 500_000


def near_atoms(atoms: DataFrame, box: int = 21, reach: float = 10.0, spacing: float = 1.0, ordered: bool = False, dealt: int | None = None) -> DataFrame:
    """Atoms that can be in the box under a rotation, dealt by complex to as many tasks as keep each at some ``dealt`` (DEALT) atoms; ``ordered``: a task's rows come one complex after the other."""
    limit = reach_of(box, reach, spacing)
    near = atoms.where(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) <= limit)
    parts = max(int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-near.count() // (dealt or DEALT)))
    near = near.repartition(parts, "complex_id")
    return near.sortWithinPartitions("complex_id") if ordered else near


def placed_atoms(atoms: DataFrame, n: int = 24, box: int = 21, reach: float = 10.0, spacing: float = 1.0, ordered: bool = False) -> DataFrame:
    """``voxel_index`` of each atom under ``n`` rotations, dealt by complex: atoms that can't be in the box go before the rotations.

    There are as many tasks as keep each at some DEALT atoms. ``ordered``: a task's rows come one
    complex after the other, which sorts atoms once, not their rotations.
    """
    return voxel_index(rotate(near_atoms(atoms, box, reach, spacing, ordered), n), box, reach, spacing)


def voxelize(atoms: DataFrame, features: dict[str, Column], n: int = 24, box: int = 21, reach: float = 10.0, spacing: float = 1.0) -> DataFrame:
    """Sums of the features in each occupied voxel: a sparse grid; atoms that can't be in it go before the rotations.

    Atoms are dealt by complex before they are rotated: the sums here, and any by complex that
    follow, need no shuffle of their own. There are as many tasks as keep each at some DEALT
    atoms, since all voxels of a task's atoms stand in its hash table.
    """
    placed = placed_atoms(atoms, n, box, reach, spacing)
    return placed.groupBy("complex_id", "rotation", "ix", "iy", "iz").agg(*[F.sum(v).alias(k) for k, v in features.items()])


def score_poses(grid: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A linear scorer: weighted sums of the grid, averaged over rotations."""
    one = grid.groupBy("complex_id", "rotation").agg(sum((F.sum(k) * w for k, w in weights.items()), F.lit(0.0)).alias("s"))
    return one.groupBy("complex_id").agg(F.avg("s").alias("score"))


def score_with(grid: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """A caller's scorer over whole complexes: it gets one complex and rotation's voxels at a time, as a frame straight from Arrow; ``load`` runs once a worker."""
    loaded: list = []

    def run(key: tuple, voxels: pd.DataFrame) -> pd.DataFrame:
        if not loaded:
            loaded.append(load())
        return pd.DataFrame({"complex_id": [key[0]], "rotation": [key[1]], "s": [float(loaded[0](voxels).sum())]})

    one = grid.groupBy("complex_id", "rotation").applyInPandas(run, "complex_id long, rotation int, s double")
    return one.groupBy("complex_id").agg(F.avg("s").alias("score"))


def score_batches(grid: DataFrame, features: list[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 128, box: int = 21, dtype: str = "float32", dealt: bool = False) -> DataFrame:
    """``complex_id, score``: a caller's scorer over dense grids, ``batch`` complexes and rotations a call, averaged over rotations.

    The scorer gets an array ``(n, box, box, box, features)``, n being ``batch`` but for a task's
    last call, and gives n scores; ``load`` runs once a task. Voxels come sorted by complex and
    rotation, so one array is filled as they stream by, and memory is that of a batch, however
    many complexes a task has. ``dealt``: the grid is dealt by complex, as ``voxelize`` leaves it.
    Rows without a complex id belong to no complex.
    """
    ids = dict(grid.dtypes)["complex_id"]
    rows = grid.where("complex_id IS NOT NULL").select("complex_id", "rotation", "ix", "iy", "iz", *features)
    rows = (rows if dealt else rows.repartition("complex_id")).sortWithinPartitions("complex_id", "rotation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, dense = load(), np.zeros((batch, box, box, box, len(features)), dtype)
        held, touched, last = [], [], None

        def flush() -> pa.RecordBatch:
            scores = np.asarray(scorer(dense[: len(held)]), np.float64)
            out = pa.record_batch({"complex_id": pa.array([k[0] for k in held], kind), "rotation": pa.array([k[1] for k in held], pa.int32()), "s": pa.array(scores)})
            for at in touched:
                dense[at] = 0
            held.clear()
            touched.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            kind = b["complex_id"].type
            names, turn = b["complex_id"].to_numpy(zero_copy_only=False), np.asarray(b["rotation"])
            new = np.append(last != (names[0], turn[0]), (names[1:] != names[:-1]) | (turn[1:] != turn[:-1]))
            last = names[-1], turn[-1]
            slot, at = len(held) - 1 + np.cumsum(new), [np.asarray(b[c]).astype(np.int64) for c in ("ix", "iy", "iz")]
            values = np.stack([b[c].to_numpy(zero_copy_only=False).astype(dtype) for c in features], 1)
            first = 0
            while first < len(slot):
                end = first + int(np.searchsorted(slot[first:], batch))
                place = slot[first:end], *(x[first:end] for x in at)
                np.add.at(dense, place, values[first:end])
                touched.append(place)
                held += [(names[i], int(turn[i])) for i in np.flatnonzero(new[first:end]) + first]
                first = end
                if first < len(slot):  # another complex or rotation begins, and the array is full
                    yield flush()
                    slot = slot - batch
        if held:
            yield flush()

    one = rows.mapInArrow(run, f"complex_id {ids}, rotation int, s double")
    return one.groupBy("complex_id").agg(F.avg("s").alias("score"))


def _grid_steps() -> tuple[Callable, Callable]:
    """The two steps of scorers of occupied cells. They are made here, so that they travel with the scorer: workers need not have this package."""

    def whole_complexes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches sorted by complex, cut so that each complex is in one of them; and which of their rows begin one."""
        held = None

        def begun(whole: pa.RecordBatch) -> np.ndarray:
            names = whole["complex_id"]
            return np.append(True, np.asarray(pc.not_equal(names[1:], names[:-1])))

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            new = begun(b)
            cut = int(np.flatnonzero(new)[-1])
            held = b.slice(cut)
            if cut:
                yield b.slice(0, cut), new[:cut]
        if held is not None:
            yield held, begun(held)

    def scored_grids(scorer: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], first: np.ndarray, cells: np.ndarray, values: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each grid begins, by ``first``, and its score: ``batch`` grids a call at most."""
        grid, start = np.cumsum(first) - 1, np.flatnonzero(first)
        edges, s = np.append(start, len(first)), np.empty(len(start))
        for at in range(0, len(start), batch):
            end = min(at + batch, len(start))
            here = slice(edges[at], edges[end])
            s[at:end] = scorer(end - at, grid[here] - at, cells[here], values[here])
        return start, s

    return whole_complexes, scored_grids


def score_occupied(placed: DataFrame, features: dict[str, Column], load: Callable[[], Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]], batch: int = 128, box: int = 21) -> DataFrame:
    """``complex_id, score``: a caller's scorer over the occupied cells of grids, ``batch`` complexes and rotations a call at most, averaged over rotations.

    For scorers to which an empty cell says nothing: of a grid's ``box`` ** 3 cells only those with
    atoms are made. The scorer gets the number n of grids, and of each atom its grid (from 0), its
    cell (of the flattened box) and its features; it gives n scores. Atoms of one cell come apart, to
    be added up. ``placed`` is that of ``placed_atoms(..., ordered=True)``; ``load`` runs once a task,
    and a task holds a batch of rows and one complex. Rows without a complex id belong to no complex.
    """
    ids, kept, (whole_complexes, scored_grids) = dict(placed.dtypes)["complex_id"], list(features), _grid_steps()
    cell = ((F.col("ix") * box + F.col("iy")) * box + F.col("iz")).cast("int").alias("cell")
    rows = placed.where("complex_id IS NOT NULL").select("complex_id", "rotation", cell, *[v.cast("double").alias(k) for k, v in features.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for whole, new in whole_complexes(batches):
            turn, nth = np.asarray(whole["rotation"]), np.cumsum(new) - 1
            turns = int(turn.max()) + 1
            order = np.argsort(code := nth * turns + turn, kind="stable")
            code, cells = code[order], np.asarray(whole["cell"])[order]
            values = np.stack([whole[k].to_numpy(zero_copy_only=False) for k in kept], 1)[order]
            start, s = scored_grids(scorer, np.append(True, code[1:] != code[:-1]), cells, values, batch)
            of = code[start] // turns
            score = np.bincount(of, s) / np.bincount(of)
            yield pa.record_batch({"complex_id": whole["complex_id"].filter(pa.array(new)), "score": pa.array(score)})

    return rows.mapInArrow(run, f"complex_id {ids}, score double")


def score_turned(atoms: DataFrame, features: dict[str, Column], load: Callable[[], Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]], n: int = 24, batch: int = 128, box: int = 21, reach: float = 10.0, spacing: float = 1.0) -> DataFrame:
    """``score_occupied`` of the placed ``atoms``, which the scorer's tasks rotate themselves: an atom goes there once, not once a rotation.

    A call's grids are of one rotation. A null feature counts as zero, as in a sum.
    """
    ids, turns = dict(atoms.dtypes)["complex_id"], [np.array(m, np.float64).reshape(3, 3) for m in rotations()[:n]]
    near = near_atoms(atoms.where("complex_id IS NOT NULL"), box, reach, spacing, True, STREAMED)
    of = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, v in features.items()]
    rows = near.select("complex_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], *of)
    sides, (whole_complexes, scored_grids) = np.array([box * box, box, 1]), _grid_steps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for whole, new in whole_complexes(batches):
            nth, names = np.cumsum(new) - 1, whole["complex_id"].filter(pa.array(new))
            at, values = (np.stack([c.to_numpy(zero_copy_only=False) for c in part], 1) for part in (whole.columns[1:4], whole.columns[4:]))
            total, met = np.zeros(len(names)), np.zeros(len(names), np.int64)
            for m in turns:
                place = np.rint((at @ m + reach) / spacing)
                inside = np.flatnonzero(((place >= 0) & (place <= box - 1)).all(1))
                if not len(inside):
                    continue
                own = nth[inside]
                start, s = scored_grids(scorer, np.append(True, own[1:] != own[:-1]), place[inside].astype(np.int64) @ sides, values[inside], batch)
                total[own[start]] += s
                met[own[start]] += 1
            found = met > 0
            yield pa.record_batch({"complex_id": names.filter(pa.array(found)), "score": pa.array(total[found] / met[found])})

    return rows.mapInArrow(run, f"complex_id {ids}, score double")


#: Receptors' atoms up to which they are sent to all tasks, complexes of a tile and rows of a task, about.
SENT, TILE, MADE = 2_000_000, 512, 20_000_000


def assemble(poses: DataFrame, receptors: DataFrame, repeat_receptor: bool = False) -> DataFrame:
    """Complexes: receptor atoms, then those of the pose; the receptor again after each pose on request.

    The poses' names are few bytes, but each becomes a whole receptor: they are dealt over tasks
    by the rows that they become. The receptors go to all tasks if they are few enough, so that no row
    made is shuffled or spilled. A receptor's atoms come one after the other, each for up to TILE complexes:
    four columns have runs, and the ids repeat, so that rows take a fraction of a byte in a column store.
    """
    cols, size = ["complex_id", "part", "ord", "atom_type", "x", "y", "z"], TILE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = pa.Table.from_batches([batch]).group_by("model_name", use_threads=False).aggregate([("complex_id", "list")]).combine_chunks()
            ids, ends = by["complex_id_list"].combine_chunks(), np.cumsum(np.asarray(pc.list_value_length(by["complex_id_list"])))
            edges = np.unique(np.concatenate([np.arange(a, b, size) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)] + [ends]))
            model = by["model_name"].combine_chunks().take(pa.array(np.searchsorted(ends, edges[:-1], side="right")))
            yield pa.record_batch({"model_name": model, "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids.flatten())})

    of = receptors.agg(F.count("*").alias("n"), F.count_distinct("model_name").alias("models")).first()
    asked = math.ceil(poses.count() * of["n"] / max(of["models"], 1) / MADE)
    tasks = max(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked)
    kinds = dict(poses.dtypes)
    tiles = poses.select("complex_id", "model_name").repartition(tasks, "complex_id", "model_name").distinct()
    tiles = tiles.mapInArrow(cut, f"model_name {kinds['model_name']}, ids array<{kinds['complex_id']}>")
    atoms = receptors.drop("complex_id")
    met = tiles.join(F.broadcast(atoms) if of["n"] <= SENT else atoms, "model_name").withColumn("complex_id", F.explode("ids"))
    parts = met.withColumn("part", F.lit(0)).select(*cols).unionByName(poses.withColumn("part", F.lit(1)).select(*cols))
    return parts.unionByName(met.withColumn("part", F.lit(2)).select(*cols)) if repeat_receptor else parts


def complex_qc(atoms: DataFrame) -> DataFrame:
    """Which molecule codes a complex has and whether any charge is not zero."""
    has = lambda code: F.max(F.col("molcode") == code)
    return atoms.groupBy("complex_id").agg(F.count("*").alias("n_atoms"), has(1).alias("has_ligand"), has(-1).alias("has_protein"), F.max(F.abs("charge") > 1e-9).alias("has_charge"))


def charge_scale(atoms: DataFrame) -> DataFrame:
    """Mean and population deviation of the charges; the rounded deviation is the one that is saved."""
    return atoms.agg(F.avg("charge").alias("mean"), F.stddev_pop("charge").alias("std"), F.round(F.stddev_pop("charge"), 3).alias("saved_std"))


def scale_charge(atoms: DataFrame, rounded: bool = True) -> DataFrame:
    """Charges over the deviation; a one-row aggregate comes back as a literal."""
    row = charge_scale(atoms).first()
    by = row["saved_std" if rounded else "std"]
    return atoms.withColumn("charge", F.when(F.lit(bool(by)), F.col("charge") / F.lit(by or 1.0)).otherwise(F.col("charge")))
