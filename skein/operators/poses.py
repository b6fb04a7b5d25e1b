"""Pose selection: score joins, ranks, the consensus pick with fallback, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import band, energy_to_kd, heavy, sample_key
from skein.operators.tables import rejects

PAIR, POSE = ["gene", "compound"], ["model_name", "pose_id"]


def score_join(distances: DataFrame, energies: DataFrame, scores: DataFrame) -> DataFrame:
    """Poses that have all three scores.

    Each table is dealt once, by the join's keys, which serves its distinct rows and both joins.
    """
    on = [*PAIR, *POSE]
    parts = int(distances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [t.repartition(parts, *on).distinct() for t in (distances, energies, scores)]
    return dealt[0].join(dealt[1], on).join(dealt[2], on)


def scores_joined(scores: DataFrame) -> DataFrame:
    """``score_join`` of the three columns of one table, ``distance``, ``energy_kcal`` and ``kdmodel``: dealt and grouped once, not once a score.

    A pose's different values of each score are met with those of the others, as in a join; null is a
    value, a null in a pose's name is no pose.
    """
    on, values = [*PAIR, *POSE], ["distance", "energy_kcal", "kdmodel"]
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = scores.select(*on, *values).dropna(subset=on).repartition(parts, *on)
    met = named.groupBy(*on).agg(*[F.array_distinct(F.collect_set(F.struct(c))).alias(c) for c in values])
    for c in values:
        met = met.withColumn(c, F.explode(c))
    return met.select(*on, *[F.col(c)[c].alias(c) for c in values])


def score_ranks(scored: DataFrame) -> DataFrame:
    """Rank (ties: least) by energy and by model score within a pair; a null score has no rank."""
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(*PAIR).orderBy(F.col(c).asc_nulls_last())))
    return scored.withColumns({"rank_vina": rank("energy_kcal"), "rank_model": rank("kdmodel")})


def pick_pose(scored: DataFrame, radius: float = 10.0) -> DataFrame:
    """One pose a pair: least mean rank among poses within ``radius``, or among all if none is.

    One shuffle by pair serves the test for near poses, both ranks and the pick. Mean of
    the ranks there are; ties by model and pose.
    """
    pair = Window.partitionBy(*PAIR)
    near = F.coalesce(F.col("distance") <= radius, F.lit(False))
    scored = scored.withColumn("has_near", F.max(near).over(pair)).where(near | ~F.col("has_near"))
    ranked = score_ranks(scored)
    total = F.coalesce("rank_vina", F.lit(0)) + F.coalesce("rank_model", F.lit(0))
    n = F.col("rank_vina").isNotNull().cast("int") + F.col("rank_model").isNotNull().cast("int")
    ranked = ranked.withColumn("rank_avg", F.when(n > 0, total / n))
    best = F.row_number().over(pair.orderBy(F.col("rank_avg").asc_nulls_last(), *POSE))
    out = ranked.withColumn("nth", best).where("nth = 1")
    return out.select(*PAIR, *POSE, "distance", energy_to_kd(F.col("energy_kcal")).alias("kdvina"), "kdmodel", "rank_avg", (~F.col("has_near")).alias("fallback"))


def best_by_energy(scored: DataFrame) -> DataFrame:
    """The pose with the least energy; ties by model and pose. An aggregate, no sort."""
    best = F.min(F.struct("energy_kcal", *POSE)).alias("m")
    return scored.where("energy_kcal IS NOT NULL").groupBy(*PAIR).agg(best).select(*PAIR, "m.*")


def pick_negative(wishes: DataFrame, distances: DataFrame, seed: object = 0) -> DataFrame:
    """A seeded choice of a far pose for each wish ``(gene, compound, dataset, dist_bin)``.

    Poses of the wanted band, else of the other one, whose label and bin the row then has;
    else a row without a pose. Wishes without a band give no row. Datasets other than KD and
    KI are not picked from.
    """
    wishes = wishes.where("dist_bin IN ('medium', 'high') AND dataset IN ('KD', 'KI')")
    far = distances.withColumn("found", band(F.col("distance"))).where("found IS NOT NULL").select(*PAIR, *POSE, "distance", "found")
    met = wishes.join(far, PAIR, "left")
    order = Window.partitionBy(*PAIR, "dataset").orderBy(F.coalesce(F.col("found") != F.col("dist_bin"), F.lit(True)), sample_key(seed, *PAIR, *POSE), *POSE)
    out = met.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    bin_ = F.coalesce("found", "dist_bin")
    return out.select(*PAIR, F.when(F.col("dataset") == "KD", "NEG1").otherwise("NEG2").alias("dataset"), bin_.alias("dist_bin"), F.when(bin_ == "medium", 2.7).otherwise(3.2).alias("expt"), *POSE, "distance")


def negative_rejects(wishes: DataFrame) -> DataFrame:
    """The wishes that ``pick_negative`` can't serve, with the reason: a band that there isn't, or a dataset without a negative label; no band at all is no wish."""
    known = {"unknown band": ~F.col("dist_bin").isin("medium", "high"), "unknown dataset": ~F.coalesce(F.col("dataset").isin("KD", "KI"), F.lit(False))}
    return rejects(wishes.where("dist_bin IS NOT NULL"), known).where("reject_reason IS NOT NULL")


SETS = ["training", "validation", "test"]


def training_picks(positive: DataFrame, negative: DataFrame, folds: DataFrame | dict[int, Column]) -> DataFrame:
    """Positive and negative picks in one table, with model, pose and set of each fold in columns of its own.

    ``folds`` says which folds use a pick for what: a table ``(gene, compound, dataset, cv,
    cvset)``, or each fold's set as a column of the picks, which needs no join. A fold's columns
    are null where none is named.
    """
    both = positive.unionByName(negative, allowMissingColumns=True)
    if isinstance(folds, dict):
        cvs, out = sorted(folds), both.withColumns({f"cv{k}_cvset": c for k, c in sorted(folds.items())})
    else:
        cvs = sorted(r[0] for r in folds.select("cv").distinct().collect())
        of = [F.max(F.when(F.col("cv") == k, F.col("cvset"))).alias(f"cv{k}_cvset") for k in cvs]
        out = both.join(folds.groupBy(*PAIR, "dataset").agg(*of), [*PAIR, "dataset"], "left")
    used = lambda k, c: F.when(F.col(f"cv{k}_cvset").isNotNull(), F.col(c))
    return out.withColumns({f"cv{k}_{c}": used(k, c) for k in cvs for c in POSE})


def cv_fanout(picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row ``(..., cv, model_name, pose_id, cvset)`` for each pick and fold in which it is used, and the rows whose set is none of SETS."""
    cvs = sorted(int(c[2:-6]) for c in picks.columns if c.startswith("cv") and c.endswith("_cvset"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cv"), *[F.col(f"cv{k}_{c}").alias(c) for c in (*POSE, "cvset")]) for k in cvs]))
    kept = [c for c in picks.columns if c not in POSE and not c.startswith("cv")]
    rows = picks.select(*kept, each.alias("f")).select(*kept, "f.*").where("cvset IS NOT NULL")
    return rows.where(F.col("cvset").isin(SETS)), rows.where(~F.col("cvset").isin(SETS))


def stored_complexes(fan: DataFrame, atoms: DataFrame, receptors: DataFrame) -> DataFrame:
    """The complex of each row of ``fan`` without a copy of its receptor: the pose's heavy atoms, centred, and the ``center`` by which the receptor of ``model_name`` is to be moved.

    ``atoms(model_name, pose_id, ord, atom_type, x, y, z)`` are looked up by model and pose; a pair's
    KD and KI rows stay apart, since ``dataset`` is part of the name. A ligand is gathered once for a
    pose, however many folds and rows use it. ``reject_reason`` says what a complex lacks. A table of
    these grows with the rows; ``with_receptors`` puts the receptors' atoms in.
    """
    wanted = fan.select(*POSE).distinct()
    own = atoms.join(wanted, POSE, "left_semi").where(heavy(F.col("atom_type"), "typed"))
    ligand = own.groupBy(*POSE).agg(F.array_sort(F.collect_list(_atom())).alias("ligand"), F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("center"))
    ligand = ligand.select(*POSE, _moved("ligand"), "center")
    known = receptors.select("model_name").distinct().withColumn("known", F.lit(True))
    # The rows are dealt once, by pose; gathering them by pair before would deal them twice.
    out = fan.join(ligand, POSE, "left").join(known, "model_name", "left")
    name = F.concat(F.concat_ws("|", *PAIR), F.lit("_"), "dataset").alias("name")
    reason = F.when(F.col("ligand").isNull(), "no pose").when(F.col("known").isNull(), "no receptor").alias("reject_reason")
    return out.select(*fan.columns, "ligand", "center", name, reason)


def _atom() -> Column:
    return F.struct("ord", "atom_type", "x", "y", "z")


def _moved(c: str) -> Column:
    """Atoms relative to the center."""
    return F.transform(c, lambda a: F.struct(a["ord"].alias("ord"), a["atom_type"].alias("atom_type"), *[(a[x] - F.col(f"center.{x}")).alias(x) for x in "xyz"])).alias(c)


def with_receptors(stored: DataFrame, receptors: DataFrame) -> DataFrame:
    """Stored complexes with their receptor's atoms, centred on the ligand; a complex without a ligand has none."""
    protein = receptors.groupBy("model_name").agg(F.array_sort(F.collect_list(_atom())).alias("receptor"))
    rest = [c for c in stored.columns if c not in ("center", "name", "reject_reason")]
    met = stored.join(protein, "model_name", "left")
    return met.select(*rest, F.when(F.col("ligand").isNotNull(), _moved("receptor")).alias("receptor"), "name", "reject_reason")


def training_complexes(fan: DataFrame, atoms: DataFrame, receptors: DataFrame) -> DataFrame:
    """The complex of each row of ``fan``: the pose's heavy atoms and its receptor's, centred on the ligand; see ``stored_complexes``, which many rows should be written as."""
    return with_receptors(stored_complexes(fan, atoms, receptors), receptors)


def run_allocation(models: DataFrame, budget: int, seed: object = 0) -> DataFrame:
    """Docking runs of each model of a domain: the budget spread evenly, the rest to random ones; with more models than budget one run each for random ones."""
    w = Window.partitionBy("domain")
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(sample_key(seed, "domain", "model_name"), "model_name"))
    runs = F.when(n < budget, F.floor(F.lit(budget) / n) + (r <= F.pmod(F.lit(budget), n)).cast("int")).otherwise((r <= budget).cast("int"))
    return models.select("domain", "model_name", runs.cast("long").alias("runs")).where("runs > 0")


def with_identity(models: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models with their sequence identity, and those that have none."""
    on = ["domain", "model_name"]
    return models.join(identities, on), models.join(identities, on, "left_anti")


def eligible_models(models: DataFrame, identity: float, excluded: list[str]) -> DataFrame:
    """Models of each domain with enough identity, one of each class of similar ones, as a sorted list; domains without any have an empty list."""
    ok = models.where((F.col("identity") >= identity) & ~F.col("model_name").isin(excluded))
    kept = ok.groupBy("domain", "rmsd_class").agg(F.min("model_name").alias("m")).groupBy("domain").agg(F.array_sort(F.collect_list("m")).alias("models"))
    out = models.select("domain").distinct().join(kept, "domain", "left")
    return out.select("domain", F.coalesce("models", F.array().cast("array<string>")).alias("models")).withColumn("n_models", F.size("models"))
