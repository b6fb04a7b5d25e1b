"""Operator 13: phrase collocations by Toivonen mining.

A sample of the documents, mined at a lowered threshold, proposes the frequent phrases of each
language. One pass over all documents then counts exactly the proposed phrases and their
negative border: every phrase whose two longest parts (without its last and without its first
word) are proposed, whether or not it is itself. If no phrase of the border proves frequent,
no frequent phrase can be missing. If some do, further passes count what they add to the
border, until it is closed. Phrases of one word are all counted.

A phrase is the list of its words' 64-bit hashes (XXH3, seeded by the language), so words are
told apart up to collisions of those. Tasks test proposals in a Bloom filter of bounded size: a
false positive counts a phrase too many, never one too few; past its size the filter prunes less.
Occurrences are counted within each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import buffers, chunks, pieces, texts
from skein.sources.scratch import materialize

WORDS = 4
KEYS = [f"w{i}" for i in range(1, WORDS + 1)]
PHRASES = "w1 long, w2 long, w3 long, w4 long, n long"
#: Text of a block: its numbers take some 25 times as much in a Python worker.
BLOCK_BYTES = 2 << 20
#: Bits of a filter at most: 16 MB.
FILTER_BITS = 1 << 27
#: Part of the documents that proposes phrases, one in so many.
SAMPLE = 8
NO_LANG = "und"


def _break_table() -> np.ndarray:
    """Of each byte: 0 part of a word, 1 blank, 2 end of a piece."""
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return kind


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, piece)`` of each word; pieces end at their marks and with their document."""
    kind = _break_table()[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]) | inside & edge[:-1])
    ends = np.flatnonzero(inside & np.append(~inside[1:], True) | inside & edge[1:]) + 1
    # Marks up to each word, not up to each byte.
    piece = np.searchsorted(np.flatnonzero((kind == 2) | edge[:-1]), starts, side="right")
    return starts, ends, piece


def _mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def combined(words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number of each phrase, from its words' hashes; order and length matter."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = _mixed(out * np.uint64(3) + w.view(np.uint64) + np.uint64(len(words)))
    return out


class Filter:
    """A Bloom filter with two probes in one word of 64 bits."""

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes

    @staticmethod
    def places(h: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
        one = np.uint64(1)
        mask = one << (h & np.uint64(63)) | one << ((h >> np.uint64(6)) & np.uint64(63)) | one << ((h >> np.uint64(12)) & np.uint64(63))
        return ((h >> np.uint64(18)) % np.uint64(n_lanes)).astype(np.int64), mask

    def has(self, h: np.ndarray) -> np.ndarray:
        lane, mask = self.places(h, len(self.lanes))
        return (self.lanes[lane] & mask) == mask


def filter_of(hashes: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of the column ``h``: at most ``bits`` bits reach the driver, whatever the number of rows."""
    n_lanes = max(64, min(bits, 16 * hashes.count()) // 64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lane, mask = Filter.places(np.asarray(b["h"]).view(np.uint64), n_lanes)
            yield pa.record_batch({"lane": pa.array(lane), "mask": pa.array(mask.view(np.int64))})

    set_bits = hashes.select("h").mapInArrow(place, "lane long, mask long").groupBy("lane").agg(F.bit_or("mask").alias("mask")).toArrow()
    lanes = np.zeros(n_lanes, np.uint64)
    lanes[np.asarray(set_bits["lane"])] = np.asarray(set_bits["mask"]).view(np.uint64)
    return Filter(lanes)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, list[str]]]:
    """Of each block of texts: hash of each word, piece of each word, distinct words with their language's number, languages."""
    held, size = [], 0

    def block():
        # Documents of one language after the other: a word's number then tells its language.
        langs = sorted({x for _, lang in held for x in lang})
        out_hash, out_piece, names, last = [], [], [], 0
        for k, lang in enumerate(langs):
            seed = xxhash.xxh3_64_intdigest(lang)
            own = [t.filter(pa.array([x == lang for x in ls])) for t, ls in held]
            data, offsets = buffers(pa.chunked_array(own, pa.string()))
            lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            starts, ends, piece = cut_words(lower, offsets)
            coded = pieces(lower, starts, ends).dictionary_encode()
            digest = xxhash.xxh3_64_intdigest
            hashes = np.array([digest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
            out_hash.append(hashes[np.asarray(coded.indices)] if len(starts) else np.zeros(0, np.uint64))
            out_piece.append(piece + last)
            last += int(piece[-1]) + 1 if len(piece) else 0
            names.append((k, coded.dictionary, hashes, np.bincount(np.asarray(coded.indices), minlength=len(hashes))))
        return np.concatenate(out_hash), np.concatenate(out_piece), names, langs

    for batch in batches:
        for part in chunks(batch, 2 << 20):
            n = int(np.sum(np.asarray(pc.binary_length(part["text"]).cast(pa.int64()))))
            if held and size + n > block_bytes:
                yield block()
                held, size = [], 0
            held.append((part["text"], part["lang"].to_pylist()))
            size += n
    if held:
        yield block()


def _in_lang(docs: DataFrame) -> DataFrame:
    return texts(docs, "lang").select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))


def word_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``w1, lang, word, n`` of every word of every language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, names, langs in _blocks(batches, block_bytes):
            for k, words, hashes, n in names:
                yield pa.record_batch({"w1": pa.array(hashes.view(np.int64)), "lang": pa.array([langs[k]] * len(hashes), pa.string()), "word": words.cast(pa.large_string()).cast(pa.string()), "n": pa.array(n.astype(np.int64))})

    return _in_lang(docs).mapInArrow(count, "w1 long, lang string, word string, n long").groupBy("w1", "lang", "word").agg(F.sum("n").alias("n"))


def hash_counts(docs: DataFrame, lengths: tuple[int, ...], known: Filter, before: Filter | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``h, k, n``: occurrences of each phrase (``combined``) of ``k`` words of ``lengths`` whose two longest parts are ``known``, but for those whose parts were known ``before``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, piece, _, _ in _blocks(batches, block_bytes):
            h = combined([w])
            # Where a known part of k words starts; a longer one can only start there.
            part, old = known.has(h), before.has(h) if before else None
            for k in range(2, max(lengths) + 1):
                n = len(w) - k + 1
                if n <= 0:
                    break
                at = np.flatnonzero(part[:n] & part[1 : n + 1] & (piece[:n] == piece[k - 1 :]))
                h = combined([w[at + i] for i in range(k)])
                fresh = ~(old[at] & old[at + 1]) if before else np.ones(len(at), bool)
                if k < max(lengths):
                    part = np.zeros(n, bool)
                    part[at] = known.has(h)
                if k < max(lengths) and before:
                    was, old = old, np.zeros(n, bool)
                    old[at] = before.has(h) & was[at] & was[at + 1]
                if k in lengths and fresh.any():
                    own = np.sort(h[fresh])
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    times = np.diff(np.append(first, len(own)))
                    for s in range(0, len(first), 1 << 18):
                        each = own[first[s : s + (1 << 18)]]
                        yield pa.record_batch({"h": pa.array(each.view(np.int64)), "k": pa.array(np.full(len(each), k, np.int32)), "n": pa.array(times[s : s + (1 << 18)])})

    # Each block counts its own: the rows are dealt before Spark adds them up, not after.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _in_lang(docs).mapInArrow(count, "h long, k int, n long").repartition(parts, "h").groupBy("h").agg(F.max("k").alias("k"), F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, wanted: Filter, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact counts (``PHRASES``), by their words, of all phrases of two words and more that are ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, piece, _, _ in _blocks(batches, block_bytes):
            for k in range(2, WORDS + 1):
                at = np.flatnonzero(piece[: max(0, len(w) - k + 1)] == piece[k - 1 :])
                h = combined([w[at + i] for i in range(k)])
                ok = wanted.has(h)
                at, h = at[ok], h[ok]
                order = np.argsort(h)
                first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0)) if len(h) else np.zeros(0, np.int64)
                at, times = at[order[first]], np.diff(np.append(first, len(h)))
                if len(at):
                    cols = [pa.array(w[at + i].view(np.int64)) if i < k else pa.nulls(len(at), pa.int64()) for i in range(WORDS)]
                    yield pa.record_batch([*cols, pa.array(times)], [*KEYS, "n"])

    return _in_lang(docs).mapInArrow(count, PHRASES).groupBy(*KEYS).agg(F.sum("n").alias("n"))


class _Either:
    """What any of the filters has."""

    def __init__(self, *filters):
        self.filters = filters

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.filters[0].has(h)
        for f in self.filters[1:]:
            out |= f.has(h)
        return out


def proposals(docs: DataFrame, singles: Filter, least: int, sample: int, bits: int):
    """A filter of the phrases of up to three words that the sample holds at the lowered threshold, each from parts that it holds."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    low, known = max(2, int(least / sample - (least / sample) ** 0.5)), singles
    for k in range(2, WORDS):
        known = _Either(known, filter_of(materialize(hash_counts(part, (k,), known).where(F.col("n") >= low)), bits))
    return known


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, sample: int = SAMPLE, bits: int = FILTER_BITS) -> DataFrame:
    """``PHRASES`` of all phrases of two to ``WORDS`` words that occur ``least`` times or more in a language.

    The border is closed on the phrases' 64-bit hashes, whose counts are never too low; then the
    frequent ones are counted by their words.
    """
    singles = filter_of(words.where(F.col("n") >= least).select(F.expr("w1 AS h")).mapInArrow(_single, "h long"), bits)
    known = proposals(docs, singles, least, sample, bits)
    found = fresh = materialize(hash_counts(docs, tuple(range(2, WORDS + 1)), known).where(F.col("n") >= least))
    # Phrases of two words are all counted: their parts, the words, are. A pass closes a length more.
    for length in range(3, WORDS + 1):
        missed = _missed(fresh.where(F.col("k") < WORDS), known)
        if missed.isEmpty():
            break
        wider = _Either(known, filter_of(missed, bits))
        fresh = materialize(hash_counts(docs, tuple(range(length, WORDS + 1)), wider, known).where(F.col("n") >= least))
        found, known = found.union(fresh), wider
    return materialize(phrase_counts(docs, filter_of(found, bits)).where(F.col("n") >= least))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"h": pa.array(combined([np.asarray(b["h"])]).view(np.int64))})


def _missed(found: DataFrame, known) -> DataFrame:
    """Frequent phrases that nobody proposed: failures of the border."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~known.has(np.asarray(b["h"]).view(np.uint64))))

    return materialize(found.mapInArrow(keep, "h long, k int, n long"))


def _part(first: int, last: int) -> list:
    """Key columns of the words ``first`` to ``last`` of a phrase."""
    return [F.col(f"w{i}") if i <= last else F.lit(None).cast("long") for i in range(first, first + WORDS)]


def scored(words: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """``lang, KEYS, a, l, r, score`` of the candidates that no longer one covers."""
    # Every part of a frequent phrase is frequent, so both tables hold all that is looked up.
    singles = words.where(F.col("n") >= least)
    every = singles.select("w1", *[F.lit(None).cast("long").alias(k) for k in KEYS[1:]], "n").unionByName(phrases)
    key = lambda cols: F.xxhash64(*[F.coalesce(c, F.lit(0)) for c in cols])
    same = lambda cols: F.struct(*[c.alias(k) for k, c in zip(KEYS, cols, strict=True)])
    each = []
    for k in range(2, WORDS + 1):
        own = phrases.where(F.col(f"w{k}").isNotNull() & (F.col(f"w{k + 1}").isNull() if k < WORDS else F.lit(True)))
        for cut in range(1, k):
            for side, (x, y) in (("l", (1, cut)), ("r", (cut + 1, k))):
                each.append(own.select(same(_part(x, y)).alias("part"), same(_part(1, k)).alias("phrase"), F.col("n").alias("a"), F.lit(cut).alias("cut"), F.lit(side).alias("side")))
    asked = each[0]
    for more in each[1:]:
        asked = asked.unionByName(more)
    counted = every.select(same([F.col(k) for k in KEYS]).alias("part"), F.col("n").alias("f"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = asked.join(counted, "part").groupBy("phrase", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
    best = cuts.groupBy("phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # The parts of two words and more of each longer candidate, with the largest count of those around them.
    around = []
    for k in range(3, WORDS + 1):
        own = phrases.where(F.col(f"w{k}").isNotNull() & (F.col(f"w{k + 1}").isNull() if k < WORDS else F.lit(True)))
        around += [own.select(same(_part(x, y)).alias("phrase"), F.col("n").alias("f")) for x in range(1, k) for y in range(x + 1, k + 1) if y - x + 1 < k]
    inside = around[0]
    for more in around[1:]:
        inside = inside.unionByName(more)
    inside = inside.groupBy("phrase").agg(F.max("f").alias("around"))
    kept = best.join(inside, "phrase", "left").where(F.col("around").isNull() | (100 * whole("around") < 80 * whole("a")))
    kept = kept.select(*[F.col(f"phrase.{k}").alias(k) for k in KEYS], "a", "best.l", "best.r", "best.score")
    return kept.join(singles.select("w1", "lang"), "w1")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, sample: int = SAMPLE, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` collocations of two to four words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts at the cut that scores
    lowest (ties: the first), ``n`` the language's words. Candidates with 80 % or more of their
    occurrences inside one longer candidate go. Null text is empty; a null language is ``und``;
    repeated rows count again; a text may be of any length; other columns are not looked at;
    ties are ranked by count, then by the phrase's bytes; an empty table gives an empty result.
    """
    words = materialize(word_counts(docs))
    phrases = frequent_phrases(docs, words, least, sample, bits)
    found = scored(words, phrases, least)
    # A language's candidates are ranked in shares first; of each share, all that ties with its last stays.
    best = found.withColumn("share", F.pmod(F.xxhash64(*KEYS), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    for share in (["share"], []):
        order = Window.partitionBy("lang", *share).orderBy(F.col("score").desc(), F.col("a").desc())
        best = best.withColumn("place", F.rank().over(order)).where(F.col("place") <= top)
    best = materialize(best)
    spelled = best
    for i, k in enumerate(KEYS):
        spelled = spelled.join(words.select(F.col("w1").alias(k), F.col("word").alias(f"t{i}")), k, "inner" if not i else "left")
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", *[f"t{i}" for i in range(WORDS)]))
    last = Window.partitionBy("lang").orderBy("place", "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
