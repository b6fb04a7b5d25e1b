"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import bpe, collocations, decontaminate, kneser_ney, projections, pseudonyms, repeats, rules, sharding, simhash, token_counts, urls, variants
from skein.sources.scratch import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARD_BYTES = 1 << 20
HOST_RATE = 0.5
#: A run's own secret in production; fixed here, so that results can be compared.
PII_KEY = b"registered query"


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), HOST_RATE)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with canonical links, judged as op7 does: the given pages have none, so each names the next one of its number as canonical.

    The pages of a number are chained in the order of their urls' hashes, so that a class is as
    many links long as it has pages.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = F.regexp_extract(urls.host_path(F.col("url"))[1], "([0-9]+)", 1)
    following = F.when(number != "", F.lead("url").over(Window.partitionBy(number).orderBy(F.xxhash64("url"), "url")))
    for character, reference in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        following = F.replace(following, F.lit(character), F.lit(reference))
    link = F.concat(F.lit('<link rel="canonical" href="'), following, F.lit('">'))
    return urls.judge(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.coalesce(link, F.lit("")))))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repeats, op2_kneser_ney, op3_simhash, op4_extendible_sharding, op5_host_rules, op6_pseudonyms, op7_url_filter, url_aliases, op8_decontamination, op9_byte_bpe, op10_token_counts, op11_spelling_variants, op12_nearest_neighbours, op13_collocations)}
ORACLES = {"op4_extendible_sharding": sharding.oracle(SHARD_BYTES), "op5_host_rules": rules.oracle(HOST_RATE), "op7_url_filter": urls.oracle(), "url_aliases": urls.aliases_oracle()}
