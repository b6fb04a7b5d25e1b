"""Row-level operators over pair and score tables: first rows, backlogs, batches, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import sample_key
from skein.sources.scratch import fresh, materialize


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; null keys are keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sample_rows(df: DataFrame, group: list[str], key: list[str], n: Column | int, seed: object = 0) -> DataFrame:
    """``n`` rows of each group without replacement, the same for any partitioning."""
    w = Window.partitionBy(*group).orderBy(sample_key(seed, *group, *key), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def missing(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Keys without a row in ``table``: what a reader of one file a key would have skipped."""
    return keys.select(*on).distinct().join(table.select(*on), on, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; a keyed append must find none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def map_ids(df: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their mapped id, and the keys that the mapping lacks."""
    return df.join(mapping, key), df.select(key).distinct().join(mapping, key, "left_anti")


def backlog(jobs: DataFrame, outputs: DataFrame, mapping: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """Jobs to run: no output yet, gene mapped, domain with models."""
    left = jobs.join(outputs.select(*on), on, "left_anti")
    return left.join(mapping, "gene").join(models.select("domain").distinct(), "domain", "left_semi")


def unfinished(jobs: DataFrame, outputs: DataFrame, wanted: int, on: list[str]) -> DataFrame:
    """Jobs with fewer than ``wanted`` finished outputs, and how many they have."""
    count = outputs.groupBy(*on).agg(F.count("*").alias("n_done"))
    return jobs.join(count, on, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0))).where(F.col("n_done") < wanted)


def row_slice(df: DataFrame, order: list[str], begin: int, end: int) -> DataFrame:
    """Rows ``begin`` to ``end`` (not included, from 0) in ``order``: a sorted limit, no numbering of all rows."""
    return df.orderBy(*order).offset(begin).limit(end - begin)


def clean_poses(df: DataFrame, model: str = "model_name", pose: str = "pose_id") -> DataFrame:
    """The distinct model and pose of rows that have both."""
    return df.na.drop(subset=[model, pose]).select(model, pose).distinct()


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], row: str = "row") -> DataFrame:
    """``df`` with each row's number from 0 in ``order``, as ``row``, and the running totals ``sums`` up to and with it.

    A distributed prefix sum: rows are dealt by ranges of ``order`` and sorted, each range counts
    and sums its own, and the totals of the ranges before are added. Only a row a range reaches
    the driver. No task sees more than a range; rows of equal ``order`` stay in one, so it should
    tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part = fresh(df, "_at"), fresh(df, "_part")
    dealt = df.withColumns({name: c.cast("long") for name, c in sums.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Spark's row ids are the number of the partition and of the row in it.
    dealt = materialize(dealt.withColumn(at, F.monotonically_increasing_id()))
    dealt = dealt.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)})
    totals = dealt.groupBy(part).agg(F.count("*").alias(row), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).orderBy(part).collect()
    names, before, run = [row, *sums], [], [0] * (1 + len(sums))
    for r in totals:
        before.append((r[part], *run))
        run = [x + r[c] for x, c in zip(run, names, strict=True)]
    shift = df.sparkSession.createDataFrame(before, ", ".join(f"`{c}` long" for c in (part, *(f"_before_{c}" for c in names))))
    own = Window.partitionBy(part).orderBy(at)
    out = dealt.withColumns({c: F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).join(F.broadcast(shift), part)
    numbered = {row: F.col(at) + F.col(f"_before_{row}"), **{c: F.col(c) + F.col(f"_before_{c}") for c in sums}}
    return out.withColumns(numbered).select(*df.columns, *names)


def pending_batches(df: DataFrame, order: list[str], pending: Column, size: int, group: str | None = None) -> DataFrame:
    """``[start, end)`` row ranges that tile the input and hold ``size`` pending rows each, the last one fewer.

    The running count is taken within ``group``; without one it is over all rows, as a
    distributed prefix sum.
    """
    part = [group] if group else []
    if group:
        w = Window.partitionBy(group).orderBy(*order)
        rows = df.select(group, (F.row_number().over(w) - 1).alias("row"), pending.cast("int").alias("p"), F.sum(pending.cast("long")).over(w).alias("cum"))
    else:
        flagged = df.select(*order, pending.cast("int").alias("p"))
        rows = prefix_sums(flagged, order, {"cum": F.col("p")})
    rows = rows.withColumn("batch", F.greatest(F.lit(0), F.floor((F.col("cum") - 1) / size)).cast("long"))
    return rows.groupBy(*part, "batch").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("end"), F.sum("p").alias("n_pending"))


def minibatches(df: DataFrame, key: str, seed: object, epoch: int, size: int) -> DataFrame:
    """``key, batch`` of a shuffled epoch: the keys' places in the order of their hashes, by a distributed prefix sum."""
    rows = df.select(key, F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))).alias("_hash"))
    return prefix_sums(rows, ["_hash", key], {}).select(key, F.floor(F.col("row") / size).cast("long").alias("batch"))


def soft_cutoff(sizes: DataFrame, group: str, size: str, n: int, limit: int) -> DataFrame:
    """Element max(n - 1, round(m / 2)) (halves to even, from 0) of a group's ascending sizes, at most ``limit``.

    Sizes are counted first: a group of any number of rows comes down to its few different sizes.
    """
    counts = sizes.groupBy(group, size).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    m = F.sum("k").over(w)
    rows = counts.select(group, size, F.sum("k").over(w.orderBy(size)).alias("upto"), F.least(F.greatest(F.lit(n - 1), F.rint(m / 2).cast("int")), m - 1).alias("at"))
    return rows.where("upto > at").groupBy(group).agg(F.least(F.min(size), F.lit(limit)).alias("cutoff"))


def count_status(pairs: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Rows of each key against the expected number."""
    n = F.col("n")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("status", F.when(n == expected, "ok").when(n < expected, "fewer").otherwise("more"))


def rejects(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with the first reason that applies; null: the row is good."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(reasons.items()):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def first_status(df: DataFrame, attempts: dict[str, Column], none: str) -> DataFrame:
    """The first attempt that worked."""
    return df.withColumn("status", F.coalesce(*[F.when(t, n) for n, t in attempts.items()], F.lit(none)))


def grouped(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Count and sorted list of the distinct ``value`` of each ``key``."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("num"), F.array_sort(F.collect_set(value)).alias(name))
