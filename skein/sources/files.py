"""Readers and writers of the pose library's files: every reader takes a folder or a pattern of files at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.scratch import shuffle_cleanup

#: Measured pairs; gene ids are text, whatever they look like.
PAIRS = "gene string, compound string, smiles string, dataset string, value double, is_kinase boolean, pdb_code string"
#: Score tables, one row a pose.
SCORES = {
    "distance": "modelname string, poseID string, distance double",
    "docking": "modelname string, poseID string, energy_kcal double, energy_kd double",
}


def _token(i: int) -> Column:
    return F.get(F.split(F.trim("value"), r"\s+"), F.lit(i))


def read_table(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """CSV with a header, by an explicit schema: nothing is inferred; columns are taken by name, NaN becomes null."""
    found = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).dtypes
    has = set(found.columns)
    value = lambda c, t: F.nanvl(F.col(c).try_cast("double"), F.lit(None)) if t == "double" else F.col(c).try_cast(t)
    return found.select(*[(value(c, t) if c in has else F.lit(None).cast(t)).alias(c) for c, t in wanted])


def read_pair_scores(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All score files ``root/<gene>/<compound>_*.csv`` as one table with ``gene`` and ``compound`` from the path; empty files give no rows."""
    lines = spark.read.schema(schema).option("header", True).csv(f"{root}/*/*.csv")
    path = F.col("_metadata.file_path")
    own = lines.select(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("gene"), F.regexp_extract(path, r"/([^/_]+)_[^/]*$", 1).alias("compound"), *lines.columns)
    return own.withColumnsRenamed({"modelname": "model_name", "poseID": "pose_id"})


def read_lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """``file, ord, value`` of text files of any size, lines numbered from 1 in the order of the file.

    A file is read in splits, by as many tasks. Spark's row ids count within a task, which reads
    a split in one go, so a line's number is its id, less that of its split's first line, and
    what the splits before hold: a prefix sum over the splits. No line is shuffled or sorted;
    a row a split goes to all tasks. ``folders``: the files of a folder, in the order of their
    names, are one file, as a writer by ranges leaves them. Lines end with a line feed, or a
    carriage return and one.
    """
    part = F.col("_metadata.file_path")
    file = F.regexp_extract(part, r"^(.*)/[^/]*$", 1) if folders else part
    lines = spark.read.option("lineSep", "\n").text(path).select(part.alias("part"), file.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    count = lines.groupBy("file", "part", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("part", "split"))
    before = count.select("part", "split", (upto - F.col("n") - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(before), ["part", "split"]).select("file", (F.col("id") + F.col("shift")).cast("int").alias("ord"), "value")


def read_index(spark: SparkSession, path: str, columns: dict[str, int], skip: int = 5, comment: str = "#") -> DataFrame:
    """An index of fields between white space: ``columns`` by position, without the first ``skip`` lines and comment lines."""
    lines = read_lines(spark, path).where((F.col("ord") > skip) & ~F.col("value").startswith(comment) & (F.trim("value") != ""))
    return lines.select(*[_token(i).alias(name) for name, i in columns.items()])


def read_pair_list(spark: SparkSession, path: str) -> DataFrame:
    """``gene, compound`` of lists with one ``gene|compound`` a line; the whole line counts, its last letter too."""
    part = lambda i: F.split_part("value", F.lit("|"), F.lit(i))
    return spark.read.text(path).where(F.trim("value") != "").select(part(1).alias("gene"), part(2).alias("compound"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``target`` of each FASTA header."""
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.expr("substring(value, 2)").alias("target"))


def _domain(mark: str) -> Column:
    """What stands before ``mark`` in a file's name, or in that of its folder ``<column>=<value>``, whose value Spark has escaped once more."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    path = F.col("_metadata.file_path")
    own, dealt = F.regexp_extract(path, f"/([^/=]+){mark}", 1), F.regexp_extract(path, f"/[^/=]+=([^/]+){mark}", 1)
    return F.when(dealt != "", plain(plain(dealt))).otherwise(plain(own)).alias("domain")


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """``domain, model_name, identity`` of files or folders ``<domain>_sequence-identities`` with a model and its identity a line."""
    lines = spark.read.text(path).select(_domain("_sequence-identities"), "value").where(F.trim("value") != "")
    return lines.select("domain", _token(0).alias("model_name"), _token(1).try_cast("double").alias("identity"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``domain, model_name`` of files or folders ``<domain>_<cut-off>_unique-models`` with a model a line."""
    return spark.read.text(path).select(_domain("_[^_/]*_unique-models"), F.trim("value").alias("model_name")).where("model_name <> ''")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``gene, compound, kind`` of a listing of archive paths: a gene's protein archive, or one of a compound."""
    value = F.col("value")
    lines = spark.read.text(path).select(F.trim(value).alias("value")).where("value <> ''")
    kind = F.when(F.col("value").contains("prot_PDB"), "protein").otherwise("compound")
    stem = F.regexp_extract("value", r"([^/]+?)(?:\.zip)?$", 1)
    return lines.select(F.regexp_extract("value", r"(?:^|/)(\d+)(?:[/_.]|$)", 1).alias("gene"), F.when(kind == "compound", stem).alias("compound"), kind.alias("kind"))


def split_matrix(complexes: DataFrame, data: str = "data") -> DataFrame:
    """``xyz`` (the first three columns) and ``features`` (the rest) of each row of a complex's matrix, or of a single row."""
    nested = dict(complexes.dtypes)[data].startswith("array<array")
    part = lambda a, n: (F.transform(data, lambda r: F.slice(r, a, n)) if nested else F.slice(data, a, n))
    return complexes.withColumns({"xyz": part(1, 3), "features": part(4, 1 << 20)}).drop(data)


def write_keyed(df: DataFrame, path: str, keys: Iterable[str], by: Iterable[str], mode: str = "errorifexists", rows: int = 1_000_000, dealt: bool = False) -> None:
    """Parquet in a folder for each value of ``by``, at most ``rows`` a file; raises, and writes nothing, if a key occurs twice, here or (mode ``append``) in what is there.

    The test asks for the keys alone, so that Catalyst leaves out what only other columns need,
    joins to unique keys too. Rows are dealt by ``by`` and large values of it split over tasks by
    size. What is there is not grouped again: its keys, unique already, are only met with the new
    ones. Null keys are keys. Two appends at once don't see each other. ``dealt``: rows lie evenly over
    tasks and ``by`` has few values, so each task writes its own files and no row is dealt again.
    """
    keys, by = list(keys), list(by)
    on = [*keys, *by]
    new = df.select(*on)
    with shuffle_cleanup(df.sparkSession):
        twice = new.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").first()
    if not twice and mode == "append":
        there = df.sparkSession.read.schema(df.schema).parquet(path).select(*on).alias("there")
        same = reduce(and_, [F.col(f"there.{c}").eqNullSafe(F.col(f"new.{c}")) for c in on])
        twice = there.join(new.alias("new"), same, "left_semi").withColumn("n", F.lit(2)).first()
    if twice:
        raise ValueError(f"key {tuple(twice)[:-1]} occurs {twice['n']} times")
    out = df if dealt else df.hint("rebalance", *[F.col(c) for c in by])
    with shuffle_cleanup(df.sparkSession):
        out.write.option("maxRecordsPerFile", rows).mode(mode).partitionBy(*by).parquet(path)


def write_pose_text(spliced: DataFrame, path: str) -> None:
    """Lines ``file, ord, value, short`` as text, each file a model of the writer's part files (MODEL name ... ENDMDL); raises, and writes nothing, if a pose has too few atoms for its template."""
    bad = spliced.where("short").select("file").first()
    if bad:
        raise ValueError(f"{bad['file']}: more atom lines than atoms")
    # A model is one record of the writer: its lines stay together and in order.
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n")
    spliced.groupBy("file").agg(lines.alias("lines")).select(F.concat(F.lit("MODEL "), F.col("file").cast("string"), F.lit("\n"), "lines", F.lit("\nENDMDL")).alias("value")).write.text(path)


def read_pose_text(spark: SparkSession, path: str) -> DataFrame:
    """``file, ord, value`` of the models in text files, the model's name as file."""
    model = spark.read.option("lineSep", "ENDMDL\n").text(path)
    lines = model.select(F.regexp_extract("value", r"^MODEL (\S+)", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    # The last line break belongs to the end mark.
    last = F.max("ord").over(Window.partitionBy("file"))
    return lines.withColumn("last", last).where("ord > 0 AND ord < last").select("file", "ord", "value")
