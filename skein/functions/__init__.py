"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kcal/mol to joule, temperature in kelvin, gas constant; M to mM.
JOULE, KELVIN, GAS, UNIT = 4184.0, 298.0, 8.314, 1000.0


def sample_key(seed: object, *key: str) -> Column:
    """Sampling order that doesn't depend on partitions or engine: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def energy_to_kd(energy: Column, unit: float = UNIT) -> Column:
    """log Kd of a docking energy in kcal/mol: ln(exp(e * 4184 / (298 * 8.314)) * unit)."""
    return energy * F.lit(JOULE / (KELVIN * GAS)) + F.lit(math.log(unit))


def heavy(atom_type: Column, mode: str = "any") -> Column:
    """Not hydrogen: no H at all (``any``), or no H that something follows (``typed``: a bare H stays)."""
    return ~(atom_type.contains("H") if mode == "any" else atom_type.rlike("H."))


def band(distance: Column) -> Column:
    """medium: 10 < d < 20; high: d > 20; the bounds themselves are in no band."""
    return F.when((distance > 10) & (distance < 20), "medium").when(distance > 20, "high")


def affinity_class(value: Column) -> Column:
    """high below -4, low below ln 10, nonbinding from there on."""
    return F.when(value < -4, "high").when(value < math.log(10), "low").when(value.isNotNull(), "nonbind")


def voxel(c: Column, reach: float = 10.0, spacing: float = 1.0) -> Column:
    """Index along one axis, halves to even."""
    return F.rint((c + reach) / spacing).cast("int")


def substring_number(line: Column, start: int, width: int) -> Column:
    """A number in fixed columns, null if there is none."""
    return F.trim(F.substring(line, start, width)).try_cast("double")


def parse_name(name: Column) -> Column:
    """``gene, compound, dataset`` of a name ``gene|compound_dataset``; null where a part is missing, further parts are left out."""
    head = F.split_part(name, F.lit("_"), F.lit(1))
    part = lambda c, mark, i: F.nullif(F.split_part(c, F.lit(mark), F.lit(i)), F.lit(""))
    return F.struct(part(head, "|", 1).alias("gene"), part(head, "|", 2).alias("compound"), part(name, "_", 2).alias("dataset"))


def parse_target(target: Column) -> Column:
    """``protein, domain`` of a target's name: ``AB_HUMAN_D0`` is domain 0 of ``AB_HUMAN``, ``AB_HUMAN_2`` its second entry, domain 1; plain names have a null domain."""
    counted, second = r"^(.+)_D(\d+)$", r"^(.+_HUMAN)_(\d+)$"
    number = F.when(target.rlike(counted), F.regexp_extract(target, counted, 2).cast("int")).when(target.rlike(second), F.regexp_extract(target, second, 2).cast("int") - 1)
    protein = F.when(target.rlike(counted), F.regexp_extract(target, counted, 1)).when(target.rlike(second), F.regexp_extract(target, second, 1)).otherwise(target)
    return F.struct(protein.alias("protein"), number.alias("domain"))


def archive_stem(file: Column) -> Column:
    """A file's name without its folder and a last ``.zip``."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.zip$", "")


def rounded(c: Column, places: int) -> Column:
    """A double rounded in binary, halves away from zero, as C and SQL engines do; Spark's own ``round`` goes by the decimal text."""
    y = F.abs(c) * 10.0**places
    t = F.rint(y)
    t = F.when(y - t == 0.5, t + 1).otherwise(t)
    return F.when(y == float("inf"), c).otherwise(F.signum(c) * t / 10.0**places)
