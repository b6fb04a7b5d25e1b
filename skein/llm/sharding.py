"""Operator 4 [native]: shards by extendible hashing.

A directory is indexed by the first bits of a key's hash. A bucket whose bytes exceed the
limit is split on the next bit, and so on, until every bucket fits. Splits are worked out
on histograms: each round counts only the rows of buckets that are still too large, by eight
more bits, summed map-side, and takes for each the shallowest of the eight depths that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import materialize

#: Bits of the hash; hex digits of md5 behind it.
BITS, DIGITS = 60, 15
ROUND = 8


def key_hash(key: Column) -> Column:
    """The first 60 bits of md5 as a long, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets ``(depth, prefix, shard_bytes, shard_rows, fits)`` of ``rows(h, n_bytes)``; the prefixes tile the hash space that is used."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    if not total[1]:
        return rows.sparkSession.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long, fits boolean")
    if total[0] <= limit:
        return rows.groupBy().agg(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"), F.lit(True).alias("fits"))
    done, large, depth = [], None, 0
    while depth < BITS:
        upto = min(BITS, depth + ROUND)
        left = rows if large is None else rows.join(large, F.shiftright("h", BITS - depth) == F.col("large"), "left_semi")
        cells = materialize(left.groupBy(F.shiftright("h", BITS - upto).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        levels = None
        for d in range(depth + 1, upto + 1):
            level = cells.groupBy(F.shiftright("cell", upto - d).alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            level = level.select(F.lit(d).alias("depth"), "prefix", "shard_bytes", "shard_rows")
            levels = level if levels is None else levels.union(level)
        levels = materialize(levels)
        fits = F.col("shard_bytes") <= limit
        parents = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        child = levels.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        leaf = child.where(F.col("depth") == depth + 1).unionByName(child.where(F.col("depth") > depth + 1).join(parents, ["depth", "parent"], "left_semi"))
        done.append(leaf.select("depth", "prefix", "shard_bytes", "shard_rows", F.lit(True).alias("fits")))
        rest = levels.where(~fits & (F.col("depth") == upto))
        if rest.isEmpty():
            break
        if upto == BITS:
            done.append(rest.select("depth", "prefix", "shard_bytes", "shard_rows", F.lit(False).alias("fits")))
        large, depth = rest.select(F.col("prefix").alias("large")), upto
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return materialize(out)


def assign(docs: DataFrame, limit: int = 256 << 20, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, shard_depth, shard, shard_bytes, shard_rows, fits``: the shard of each row of ``docs``.

    ``shard`` is the hash prefix in binary digits (empty: the whole table fits one shard).
    Rows of equal ``key`` stay together; a shard that one key alone makes too large has
    ``fits`` false. Null text has no bytes; a null key hashes as the empty string; repeated
    rows are counted each; an empty table gives an empty result; other columns are not used.
    """
    slim = docs.select("doc_id", key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = materialize(slim)
    shards = directory(rows.select("h", "n_bytes"), limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())
    if not depths:
        return rows.select("doc_id", "n_bytes", F.lit(0).alias("shard_depth"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(True).alias("fits"))
    # A row's shard is the one of its prefixes that is in the directory: one look-up at each depth in use.
    looked = rows.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths])).alias("at")).select("doc_id", "n_bytes", "at.*")
    out = looked.join(shards, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "n_bytes", F.col("depth").alias("shard_depth"), name.alias("shard"), "shard_bytes", "shard_rows", "fits")


def oracle(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}))::BIGINT AS h FROM documents),
lv AS (SELECT d.*, k.k AS depth, h >> ({BITS} - k.k) AS prefix FROM d CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(0, {BITS + 1})) k),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY 1, 2),
j AS (SELECT lv.*, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY lv.doc_id ORDER BY CASE WHEN s.shard_bytes <= {limit} OR lv.depth = {BITS} THEN 0 ELSE 1 END, lv.depth) AS rn
  FROM lv JOIN s USING (depth, prefix))
SELECT doc_id, n_bytes, depth AS shard_depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
  shard_bytes, shard_rows, shard_bytes <= {limit} AS fits FROM j WHERE rn = 1"""
