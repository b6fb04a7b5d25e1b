"""Operator 5 [native]: quality rules with host verdicts.

Every document is judged by its own counts; failures are summed by host, shrunk towards the
rate of all hosts by a beta prior fitted to the hosts by moments, and hosts whose shrunk rate
exceeds a limit take their documents with them. Only built-in functions; the text stays in
its scan task, and what is joined is a few numbers a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import materialize

SYMBOLS = "#*$%&|<>"


def _counts(text: Column) -> list[Column]:
    """``words, letters, symbols, lines`` that the counts are made of."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        words.alias("words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ]


def base(docs: DataFrame) -> DataFrame:
    """``doc_id, source`` and the base counts and verdict of each row."""
    text = F.coalesce("text", F.lit(""))
    own = {c.lower() for c in docs.columns}
    source = F.col("source").cast("string") if "source" in own else F.lit(None).cast("string")
    out = docs.select("doc_id", source.alias("source"), *_counts(text))
    # Windows of three words by 64-bit hash; only texts in which one recurs are looked at closely.
    n = F.size("words")
    windows = F.expr("CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END")
    out = out.withColumn("windows", windows.cast("array<bigint>"))
    # Positions of windows that recur, in order: sorted (hash, position) pairs next to an equal hash.
    sorted_ = "array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    twins = "array_sort(transform(filter(transform(s, (x, j) -> named_struct('i', x.i, 'twin', (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h))), x -> x.twin), x -> x.i))"
    covered = "aggregate(p, named_struct('n', 0L, 'end', -1), (a, i) -> named_struct('n', a.n + least(3, i + 3 - greatest(i, a.end)), 'end', i + 3), a -> a.n)"
    # A one-element array binds a name to an intermediate array, so that it is computed once.
    repeat = f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE element_at(transform(transform(array({sorted_}), s -> {twins}), p -> {covered}), 1) END"
    out = out.withColumn("n_repeat_words", F.expr(repeat)).withColumn("n_words", n.cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(judged: DataFrame, max_rate: float) -> DataFrame:
    """``source, host_docs, host_failed, host_rate, host_blocked`` of ``judged(source, base_failed)``.

    With r = failed / docs over the hosts, m its mean and v its variance, the prior has
    strength s = m(1 - m)/v - 1 (at least 1; 1e6 if the hosts don't differ), a = ms, b = (1 - m)s.
    """
    hosts = judged.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    r = F.col("host_failed") / F.col("host_docs")
    m, v = (x or 0.0 for x in hosts.agg(F.avg(r), F.var_pop(r)).first())
    strength = max(1.0, m * (1 - m) / v - 1) if v > 1e-12 else 1e6
    rate = (F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)
    return hosts.select("source", "host_docs", "host_failed", rate.alias("host_rate"), (rate > max_rate).alias("host_blocked"))


def judge(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, the host's figures and ``kept`` of each row of ``docs``.

    Null text has no words and fails; documents without a source form one host; repeated
    rows count each; an empty table gives an empty result; other columns are not used.
    """
    judged = materialize(base(docs))
    hosts = host_rates(judged, max_rate)
    of = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    out = judged.withColumns({"k": of[0], "none": of[1]}).join(hosts.select(of[0].alias("k"), of[1].alias("none"), "host_docs", F.round("host_rate", 6).alias("host_rate"), "host_blocked"), ["k", "none"])
    kept = ~F.col("base_failed") & ~F.col("host_blocked")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_docs", "host_rate")


def oracle(max_rate: float) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM win WHERE (rid, t) IN (SELECT (rid, t) FROM win GROUP BY rid, t HAVING count(*) > 1)),
pos AS (SELECT rid, count(DISTINCT i + k.range) AS n FROM rep CROSS JOIN range(0, 3) k GROUP BY rid),
b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(pos.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN pos USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS host_docs, sum(base_failed::INT) AS f, sum(base_failed::INT) / count(*) AS r FROM j GROUP BY source),
mv AS (SELECT avg(r) AS m, var_pop(r) AS v FROM h),
pr AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1e6 END AS s FROM mv),
hr AS (SELECT source, host_docs, (f + m * s) / (host_docs + s) AS rate FROM h CROSS JOIN pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rate > {max_rate} AS kept, host_docs, round(rate, 6) AS host_rate
FROM j JOIN hr ON j.source IS NOT DISTINCT FROM hr.source"""
