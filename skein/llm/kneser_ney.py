"""Operator 2: quality by the perplexity of an interpolated modified Kneser-Ney model.

The units are bytes, in n-grams of five. Trusted text (labelled good and not toxic, all of it)
is counted; counts are sharded by context and joined with the sums of their contexts and with
the order below. Every document is in one of two folds, by its id, and is scored by the model
of the other fold's trusted text, so that none is scored by a model that has seen it: the fold
is one more bit in front of an n-gram, and one set of tables holds both models.

Documents meet the model by joins, too. A block of some MB of text sends its distinct n-grams
to shards; the shards' distinct n-grams are joined with the tables of all orders, backing off
where one has none; the answers go back to the block, whose text gives each document's
perplexity. A language's threshold is a quantile of its trusted documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import buffers, chunks, real_id, row_key, task_count, texts
from skein.sources.scratch import fresh, materialize

#: Bytes of an n-gram; with the fold, at most seven fit a long.
ORDER = 5
#: Ids of trusted documents that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Languages whose few numbers may be broadcast.
LANGUAGES = 10_000
#: Bytes at its language's mean that every document is given, so that short ones aren't judged on a few.
PRIOR_BYTES = 64.0
#: Steps of log-perplexity in which quantiles are taken.
STEP = 0.001
#: Text of a block, and positions that are looked at together.
BLOCK_BYTES, WINDOW = 8 << 20, 1 << 18
#: An n-gram's cost (negative log probability) travels to the blocks in two bytes: below CLOSE nats in steps of 1/SCALE nat,
#: from there on in steps of 1/COARSE, which reaches 1,039 nats. Double precision has no probability that small.
SCALE, CLOSE, COARSE = 2048, 16, 32
#: Discounts of a corpus too small to have n-grams of all counts up to four.
SMALL_CORPUS = (0.5, 0.75, 0.9)
LANG = "coalesce(lang, 'und')"
BLOCK_SCHEMA = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("docs", pa.binary())])


def grams(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """``(first byte, n-grams)`` of windows of the text: for each byte the n-gram that ends there; zero bytes stand before a document."""
    for first in range(0, len(data), WINDOW):
        at = np.arange(first, min(first + WINDOW, len(data)))
        document = np.searchsorted(offsets, at, side="right") - 1
        out, start = fold[document], offsets[document]
        for back in range(order - 1, -1, -1):
            out = out << 8 | np.where(at - back >= start, data[np.maximum(at - back, 0)], 0)
        yield first, out


def _merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, of = np.unique(np.concatenate(keys), return_inverse=True)
    return g, np.bincount(of, np.concatenate(values), minlength=len(g)).astype(np.int64)


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)))


def counts(trusted: DataFrame, order: int = ORDER, chunk_bytes: int = 4 << 20) -> DataFrame:
    """``g, n``: the n-grams of ``trusted(doc_id, text, fold)``, each under the other fold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for piece in chunks(batch, chunk_bytes):
                for _, found in grams(*buffers(piece["text"]), 1 - np.asarray(piece["fold"]), order):
                    g, n = np.unique(found, return_counts=True)
                    held[0].append(g)
                    held[1].append(n)
                if len(held[0]) > 16:
                    held = tuple([x] for x in _merged(*held))
        g, n = _merged(*held)
        del held
        pa.default_memory_pool().release_unused()
        for i in range(0, len(g), 1 << 16):
            yield pa.record_batch({"g": pa.array(g[i : i + (1 << 16)]), "n": pa.array(n[i : i + (1 << 16)])})

    return trusted.select("text", "fold").mapInArrow(cut, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame, above: tuple[float, float, float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; those of the order ``above`` where a count of counts is missing or the estimate is none."""
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3 and n4):
        return above
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else above


def suffix(g: Column, k: int) -> Column:
    """The last ``k`` bytes of an n-gram of ``k + 1``, with its fold."""
    return F.shiftleft(F.shiftright(g, 8 * (k + 1)), 8 * k).bitwiseOR(g.bitwiseAND(F.lit((1 << 8 * k) - 1)))


def _bounded(table: DataFrame, k: int) -> DataFrame:
    """Tables of one or two bytes have at most 2 * 65,536 rows and may be broadcast."""
    return F.broadcast(table) if k <= 2 else table


def train(trusted: DataFrame, order: int = ORDER) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order the probabilities ``(g, p)`` of its n-grams and the weights ``(context, weight)`` that their contexts leave to the order below."""
    table = {order: materialize(counts(trusted, order))}
    for k in range(order - 1, 0, -1):
        table[k] = materialize(table[k + 1].groupBy(suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("n")))
    cut = {order + 1: SMALL_CORPUS}
    for k in range(order, 0, -1):
        cut[k] = discounts(table[k], cut[k + 1])
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for k in range(1, order + 1):
        d = F.when(F.col("n") == 1, cut[k][0]).when(F.col("n") == 2, cut[k][1]).otherwise(cut[k][2])
        own = table[k].withColumn("context", F.shiftright("g", 8))
        sums = materialize(own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(d) / F.sum("n")).alias("weight")))
        joined = own.join(_bounded(sums, k - 1), "context")
        if k == 1:
            joined = joined.withColumn("q", F.lit(1 / 256))
        else:
            joined = joined.withColumn("lower", suffix(F.col("g"), k - 1)).join(_bounded(model[k - 1][0].toDF("lower", "q"), k - 1), "lower")
        p = (F.col("n") - d) / F.col("total") + F.col("weight") * F.col("q")
        model[k] = materialize(joined.select("g", p.alias("p"))), sums.select("context", "weight")
    return model


def resolve(asked: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``g, logp`` of the distinct n-grams ``asked(g)``: one join with each table; an n-gram without a probability takes its context's weight times that of its suffix."""
    order = max(model)
    out, key = asked.select("g", F.lit(math.log(1 / 256)).cast("float").alias("logp")), {order: F.col("g")}
    for k in range(order - 1, 0, -1):
        key[k] = suffix(key[k + 1], k)
    for k in range(1, order + 1):
        probability, weight = model[k]
        out = out.withColumns({"key": key[k], "context": F.shiftright(key[k], 8)})
        out = out.join(_bounded(weight.toDF("context", "weight"), k - 1), "context", "left").join(_bounded(probability.toDF("key", "own"), k), "key", "left")
        # Sums of logarithms: no product gets too small for single precision.
        out = out.select("g", F.coalesce(F.log("own"), F.coalesce(F.log("weight"), F.lit(0.0)) + F.col("logp")).cast("float").alias("logp"))
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """The byte planes of numbers of one width, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return len(numbers).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _numbers(payload: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(payload[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(payload[4:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _packed(g: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _planes(np.diff(g, prepend=0))


def _unpacked(payload: bytes) -> np.ndarray:
    return np.cumsum(_numbers(payload, np.int64))


def _blocks(rows: DataFrame, shards: int, order: int, block_bytes: int) -> DataFrame:
    """``(route, block, payload, docs)``: a block's text (route: the block) and its distinct n-grams of each shard (route: -1 - shard)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            piece = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = buffers(piece["text"])
            found = [np.zeros(0, np.int64)]
            for _, g in grams(data, offsets, np.asarray(piece["fold"]), order):
                found.append(np.unique(g))
                if len(found) > 16:
                    found = [np.unique(np.concatenate(found))]
            g = np.unique(np.concatenate(found))
            block = part << 32 | made
            made += 1
            head = piece.drop_columns(["text"]).append_column("n_bytes", pa.array(np.diff(offsets)))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(head)
            text = len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data.tobytes(), asbytes=True)
            out = [(block, block, text, sink.getvalue().to_pybytes())]
            place = g % shards
            by = np.argsort(place, kind="stable")
            used, start = np.unique(place[by], return_index=True)
            out += [(-1 - int(s), block, _packed(g[of]), None) for s, of in zip(used, np.split(by, start[1:]), strict=False)]
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, r, strict=True)) for r in out[k : k + 64]], schema=BLOCK_SCHEMA)
            del piece, data, text, out
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for piece in chunks(batch, 1 << 20):
                n = int(buffers(piece["text"])[1][-1])
                if held and size + n > block_bytes:
                    yield from flush()
                    held, size = [], 0
                held.append(piece)
                size += n
        if held:
            yield from flush()

    return rows.mapInArrow(cut, "route long, block long, payload binary, docs binary")


def coded(cost: np.ndarray) -> np.ndarray:
    """Costs in nats as two-byte codes, whose order is that of the costs."""
    fine, coarse = np.rint(cost * SCALE), CLOSE * SCALE + np.rint((cost - CLOSE) * COARSE)
    return np.where(cost < CLOSE, fine, coarse).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    """The costs of codes, in steps of 1/SCALE nat."""
    code = code.astype(np.int64)
    return np.where(code <= CLOSE * SCALE, code, CLOSE * SCALE + (code - CLOSE * SCALE) * (SCALE // COARSE))


def scores(docs: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], by_row: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, lang, n_bytes, nll`` (negative log likelihood, nats) of each row by its fold's model; with ``by_row`` its ``row_key`` too."""
    order, more = max(model), ["row_key"] if by_row else []
    parts = task_count(docs)
    shards = 2 * parts + 1
    rows = with_fold(texts(docs, "lang"))
    rows = rows.withColumn("row_key", row_key(F.expr(LANG))) if by_row else rows
    # One shuffle, which Spark reuses, feeds the three consumers; each passes over what the others take.
    dealt = _blocks(rows, shards, order, block_bytes).repartition(parts, "route")

    def distinct(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return pd.DataFrame({"g": []})
        return pd.DataFrame({"g": np.unique(np.concatenate([_unpacked(x) for x in pdf["payload"]]))})

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return pd.DataFrame({"block": [], "payload": []})
        known = right.sort_values("g")
        g, logp = known["g"].to_numpy(), known["logp"].to_numpy()
        code = coded(np.maximum(-logp.astype(np.float64), 0))
        found = [_planes(code[np.searchsorted(g, _unpacked(x))]) for x in left["payload"]]
        return pd.DataFrame({"block": left["block"], "payload": [len(x).to_bytes(4, "little") + x + f for x, f in zip(left["payload"], found, strict=True)]})

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("doc_id", "lang", "n_bytes", "nll", *more)})
        with pa.ipc.open_stream(left["docs"][0]) as stream:
            head = stream.read_next_batch()
        text = left["payload"][0]
        data = np.frombuffer(pa.decompress(text[8:], int.from_bytes(text[:8], "little"), "zstd"), np.uint8)
        cut = [4 + int.from_bytes(x[:4], "little") for x in right["payload"]]
        g = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x[4:k]) for x, k in zip(right["payload"], cut, strict=True))])
        cost = np.concatenate([np.zeros(0, np.uint16), *(_numbers(x[k:], np.uint16) for x, k in zip(right["payload"], cut, strict=True))])
        by = np.argsort(g)
        g, cost = g[by], decoded(cost[by])
        n = np.asarray(head["n_bytes"])
        offsets, nll = np.append(0, np.cumsum(n)), np.zeros(len(n))
        for first, own in grams(data, offsets, np.asarray(head["fold"]), order):
            by = np.argsort(own)
            each = np.empty(len(own), np.int64)
            each[by] = cost[np.searchsorted(g, own[by])]
            total = np.append(0, np.cumsum(each))
            ends = np.clip(offsets - first, 0, len(own))
            nll += (total[ends[1:]] - total[ends[:-1]]) / SCALE
        pa.default_memory_pool().release_unused()
        return pd.DataFrame({"doc_id": np.asarray(head["doc_id"]), "lang": head["lang"].to_pylist(), "n_bytes": n, "nll": nll, **{c: head[c].to_pylist() for c in more}})

    # What a consumer passes over is emptied above the shuffle, not filtered out: a filter would go below it and undo the reuse.
    only = lambda test: dealt.select("route", "block", *[F.when(test, F.col(c)).alias(c) for c in ("payload", "docs")])
    asked, held = only(F.col("route") < 0), only(F.col("route") >= 0)
    known = resolve(asked.groupBy("route").applyInPandas(distinct, "g long"), model)
    known = known.withColumn("route", -1 - F.pmod("g", F.lit(shards)))
    answers = asked.groupBy("route").cogroup(known.groupBy("route")).applyInPandas(answer, "block long, payload binary")
    schema = "doc_id long, lang string, n_bytes long, nll double" + ", row_key binary" * by_row
    return held.groupBy("route").cogroup(answers.groupBy("block")).applyInPandas(finish, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good and none toxic."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return said.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, by_row: bool = False) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, threshold, kept`` of each row of ``docs``.

    Perplexity is by byte, with PRIOR_BYTES more at the mean of the language. A language's
    threshold is ``slack`` times the ``quantile`` of its trusted documents, each scored by the
    model that has not seen it; languages without any take that of all trusted documents, and
    without trusted documents all are kept. Null language is a language of its own; null text
    is empty and has the mean; a text of any length is scored whole, in windows; a null id
    comes back null and is in one fold; repeated rows are judged each; other columns are not
    used; an empty table gives an empty result. ``by_row``: each row's ``row_key`` (id, language
    and text) is a column more.
    """
    ids = materialize(trusted_ids(labels))
    small = ids.count() <= BROADCAST_IDS
    trusted = with_fold(texts(docs)).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    model = train(trusted)
    each = materialize(scores(docs, model, by_row).withColumn("lang", F.expr(LANG)))
    good = each.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    by = good.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("n_bytes").alias("bytes"))
    every = by.agg(F.sum("nll"), F.sum("bytes")).first()
    overall = (every[0] / every[1]) if every[1] else 0.0
    means = by.select("lang", F.coalesce(F.try_divide("nll", "bytes"), F.lit(overall)).alias("mean"))
    langs = each.select("lang").distinct().join(means, "lang", "left").select("lang", F.coalesce("mean", F.lit(overall)).alias("mean"))
    rate = (F.col("nll") + PRIOR_BYTES * F.col("mean")) / (F.col("n_bytes") + PRIOR_BYTES)
    means = materialize(means)
    steps = good.join(F.broadcast(means) if means.count() <= LANGUAGES else means, "lang").groupBy("lang", F.ceil(rate / STEP).alias("step")).agg(F.count("*").alias("n"))
    whole = materialize(steps)
    total = whole.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    run = Window.partitionBy("lang").orderBy("step")
    ranked = whole.unionByName(total).withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy("lang"))})
    cuts = ranked.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg((F.min("step") * STEP).alias("cut"))
    cuts = materialize(cuts)
    rest = cuts.where("lang IS NULL").first()
    limits = langs.join(cuts.where("lang IS NOT NULL"), "lang", "left").select("lang", "mean", F.coalesce("cut", F.lit(rest["cut"] if rest else None).cast("double")).alias("cut"))
    perplexity, threshold = F.round(F.exp(rate), 6), F.round(slack * F.exp("cut"), 6)
    # A few languages hold all rows: their limits are broadcast, unless a table names very many.
    limits = materialize(limits)
    more = ["row_key"] if by_row else []
    out = each.join(F.broadcast(limits) if limits.count() <= LANGUAGES else limits, "lang").select("doc_id", "lang", "n_bytes", perplexity.alias("perplexity"), threshold.alias("threshold"), *more)
    return out.select(real_id(), "lang", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"), *more)


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps, each by its own id, language and text.

    Rows without an id, or of one id, do not decide for each other; repeated rows stay or go
    together; null and empty texts, long ones and empty tables are as in ``judge``; a column
    of any name may be there.
    """
    judged = judge(docs, labels, quantile, slack, by_row=True)
    bad = judged.where("NOT kept").select(F.col("row_key").alias(key := fresh(docs, "rejected_key"))).distinct()
    lang = F.expr(LANG) if "lang" in {c.lower() for c in docs.columns} else F.lit("und")
    return docs.withColumn(key, row_key(lang)).join(bad, key, "left_anti").select(*docs.columns)
