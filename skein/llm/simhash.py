"""Operator 3: SimHash near-duplicates found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18, in halves of 9). The
(23,12) Golay code is perfect: each word decodes to one codeword. The codewords that a word
decodes to after at most one flip are its keys (one or six), and words at most two bits apart
share one. Up to three differing bits over the segments then leave one of these cases:

    C has at most one error, A and B at most two each   -> a half of C, a key of A, a key of B
    C has two or three, so A or B has none, the other   -> A and a key of B, or B and a key of A
      at most one
    A or B has all three                                -> the other one and C

Fingerprints meet on those keys and are verified bit by bit. A bucket gives a spanning forest
of its links, never all its pairs. A bucket too large to compare in one task is handled
exactly another way: all words near each of its fingerprints are listed, and fingerprints
linked through them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import buffers, chunks, real_id, texts, words
from skein.plans.graph import components
from skein.sources.scratch import materialize

#: Fixed values of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, LENGTH, CHECK_BITS = 0b101011100011, 23, 11
#: Words of a shingle.
SHINGLE = 3
#: Fingerprints of one bucket that are compared in one task.
BUCKET = 8192


@cache
def _spread() -> np.ndarray:
    """Each byte's bits, one a byte of a 64-bit lane."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.view(np.uint64)[:, 0].copy()


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprint (unsigned) of each document; 0 for one without words."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    starts, ends, document = words(lower, offsets)
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    at = np.cumsum(length + 1) - length - 1
    flat = np.full(int(at[-1] + length[-1] + 1), 32, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[at + length] = False
    flat[inside] = lower[(lower != 32) & ((lower < 9) | (lower > 13))]
    n_words = np.bincount(document, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    full = np.flatnonzero(document[: len(document) - shingle + 1] == document[shingle - 1 :]) if len(document) >= shingle else np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    a = np.concatenate([at[full], at[first[short]]])
    last = np.concatenate([full + shingle - 1, first[short] + n_words[short] - 1])
    b = at[last] + length[last]
    owner = np.concatenate([document[full], short])
    order = np.argsort(owner, kind="stable")
    a, b, owner = a[order], b[order], owner[order]
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[x:y], 42) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    docs, start, n = np.unique(owner, return_index=True, return_counts=True)
    within = np.arange(len(owner)) - np.repeat(start, n)
    cuts = np.flatnonzero(within % 255 == 0)  # a lane of a byte counts to 255
    lanes = np.add.reduceat(_spread()[h.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.searchsorted(cuts, start), axis=0)
    out[docs] = np.packbits((2 * counts > n[:, None]), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, chunk_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id`` (null: NO_ID) ``, fp long`` of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, chunk_bytes):
                fp = simhash(*buffers(piece["text"]), shingle)
                yield pa.record_batch({"doc_id": piece["doc_id"], "fp": pa.array(fp.view(np.int64))})

    return texts(docs).mapInArrow(cut, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - CHECK_BITS)), x)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the twelve high bits; error pattern of each syndrome."""
    high = _syndrome(np.arange(1 << 12, dtype=np.int64) << CHECK_BITS)
    patterns = np.array([sum(1 << i for i in c) for w in range(4) for c in combinations(range(LENGTH), w)], np.int64)
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    errors[_syndrome(patterns)] = patterns
    return high, errors


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword at most three bits from each 23-bit word."""
    high, errors = _tables()
    return (x ^ errors[high[x >> CHECK_BITS] ^ (x & 0x7FF)]) >> CHECK_BITS


def golay_keys(x: np.ndarray) -> np.ndarray:
    """``(n, 6)``: the distinct codeword indices near each word, filled up with -1."""
    near = np.sort(np.stack([decode(x ^ e) for e in [0, *(1 << i for i in range(LENGTH))]], 1), 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return -np.sort(-near, 1)[:, :6]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, row)`` of all buckets of the fingerprints (signed 64-bit)."""
    u = fp.view(np.uint64)
    a, b, c = ((u & np.uint64(0x7FFFFF)).astype(np.int64), ((u >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64))
    ka, kb, row = golay_keys(a), golay_keys(b), np.arange(len(fp))
    keys, rows = [], []

    def add(kind, key, ok):
        keys.append((np.int64(kind) << 60 | key)[ok])
        rows.append(np.broadcast_to(row.reshape([-1] + [1] * (key.ndim - 1)), key.shape)[ok])

    both = ka[:, :, None] << 12 | kb[:, None, :]
    ok = (ka[:, :, None] >= 0) & (kb[:, None, :] >= 0)
    add(0, (c & 511)[:, None, None] << 24 | both, ok)
    add(1, (c >> 9)[:, None, None] << 24 | both, ok)
    add(2, a[:, None] << 12 | kb, kb >= 0)
    add(3, b[:, None] << 12 | ka, ka >= 0)
    add(4, b << 18 | c, np.ones(len(fp), bool))
    add(5, a << 18 | c, np.ones(len(fp), bool))
    return np.concatenate(keys), np.concatenate(rows)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as numpy counts those of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _apart(left, x) <= bits
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Verified links ``(a, b)`` that connect what the links at ``bits`` or fewer connect; ``distinct`` has ``fp``."""
    if not 0 <= bits <= 3:
        raise ValueError("the segments cover up to three differing bits")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            for i in range(0, len(fp), 4096):
                keys, rows = bucket_keys(np.ascontiguousarray(fp[i : i + 4096]))
                yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(fp[i + rows])})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def settle(keys, fp):
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(start, len(keys)))
            many = np.repeat(n > 1, n)
            keys, fp = keys[many], fp[many]
            n = n[n > 1]
            start, small = np.cumsum(n) - n, np.repeat(n <= 8, n)
            for step in range(1, int(min(8, n.max(initial=0)))):
                same = (keys[step:] == keys[:-step]) & small[step:]
                same &= _apart(fp[step:], fp[:-step]) <= bits
                yield rows(fp[:-step][same], fp[step:][same])
            for s, k in zip(start[n > 8], n[n > 8], strict=True):
                yield rows(*_forest(fp[s : s + k], bits))

        keys, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys, fp = np.append(keys, np.asarray(batch["key"])), np.append(fp, np.asarray(batch["fp"]))
            if hot is not None:  # the rest of a bucket that was too large
                end = np.searchsorted(keys, hot, side="right")
                yield rows(fp[:end], pa.nulls(int(end), pa.int64()))
                keys, fp = keys[end:], fp[end:]
                if not len(keys):
                    continue
                hot = None
            whole = np.searchsorted(keys, keys[-1])
            yield from settle(keys[:whole], fp[:whole])
            keys, fp = keys[whole:], fp[whole:]
            if len(keys) > bucket:
                hot = keys[-1]
                yield rows(fp, pa.nulls(len(fp), pa.int64()))
                keys, fp = keys[:0], fp[:0]
        yield from settle(keys, fp)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fingerprint becomes some seventy keys: spread the few small files of the distinct table first.
    dealt = distinct.select("fp").repartition(parts, "fp").mapInArrow(key, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = materialize(dealt.mapInArrow(verify, "a long, b long").distinct())
    near, hot = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp"))
    return near if hot.isEmpty() else near.union(_near_words(hot, bits)).distinct()


def _near_words(hot: DataFrame, bits: int) -> DataFrame:
    """Links among ``hot`` through listed words.

    Between two fingerprints ``bits`` or fewer apart lies a word that is at most half of that
    (rounded down) from one and the rest from the other; and any two that share a word so are
    linked. Each word joins its fingerprints to its nearest one: a star, not all pairs.
    """
    inner, outer = bits // 2, bits - bits // 2
    flips = [(w, sum(1 << i for i in c)) for w in range(outer + 1) for c in combinations(range(64), w)]
    near = np.array([w <= inner for w, _ in flips])
    masks = np.array([m for _, m in flips], np.uint64).view(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch["fp"])
            for i in range(0, len(fp), 256):
                own = fp[i : i + 256]
                yield pa.record_batch({"word": pa.array((own[:, None] ^ masks).ravel()), "fp": pa.array(np.repeat(own, len(masks))), "inner": pa.array(np.tile(near, len(own)))})

    listed = hot.mapInArrow(spread, "word long, fp long, inner boolean")
    hub = listed.groupBy("word").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a IS NOT NULL AND n > 1").select("word", "a")
    return listed.select("word", F.col("fp").alias("b")).join(hub, "word").where("a <> b").select("a", "b").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs``: classes of fingerprints linked at ``bits`` or fewer.

    Null text counts as empty; documents without words share fingerprint zero and are linked
    like any other; a text with fewer words than a shingle is one shingle; repeated rows and
    ids give a row each; a null id is null in both id columns only if its class has no other;
    other columns are not looked at; an empty table gives an empty result.
    """
    each = materialize(fingerprints(docs, shingle))
    distinct = materialize(each.groupBy("fp").agg(F.min(F.expr(f"nullif(doc_id, {-(2**63)})")).alias("first")))
    joined = components(links(distinct, bits, bucket)).toDF("fp", "root")
    rooted = distinct.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return each.join(of, "fp").select(real_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
