"""Operator 1: removal of repeated passages by column-wise suffix sorting of a collection.

Texts are cut where equal passages must be cut alike: every string of ``length`` bytes is
filed under its anchor, the 32-byte gram in it with the smallest hash, and neighbouring
strings with one anchor form a segment. Equal strings then lie in segments of one anchor, at
one distance from it. Segments equal as a whole need no sorting: all but the first go.

What is left are groups of different segments around one anchor. They are sorted as a
collection, right to left: each round inserts one symbol a segment, in front of the suffixes
sorted so far, by a stable pass over the Burrows-Wheeler column (the segments' next symbols
in suffix order), and updates the common prefixes of neighbours. Where neighbours share
``length`` symbols, the suffix is a repeat of the first of its run. Groups are read and
written one after the other, sorted by Spark on disk; no collection is held whole.

An anchor with very many different segments (a common line in unlike surroundings) is not
sorted in one task: its strings are grouped by a 128-bit hash instead, which deals them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.bpe import gather
from skein.llm.common import buffers, chunks, real_id, texts
from skein.sources.scratch import materialize

GRAM = 32
#: Different segments of an anchor that are sorted in one task.
GROUP = 100_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the grams of 8, 16, ... ``size`` bytes at every place."""
    if len(data) < 8:
        return [np.zeros(0, np.uint64) for _ in range(size.bit_length() - 3)]
    h = [_mix(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) * M1)]
    width = 8
    while width < size:
        low = h[-1]
        h.append(_mix(low[:-width] * M1 + low[width:] * M2) if len(low) > width else low[:0])
        width *= 2
    return h


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Of each segment: document, start and length in it, offset of the anchor, hashes of the anchor and of the segment."""
    span = length - GRAM + 1  # grams in a string
    none = np.zeros(0, np.int64)
    empty = {"document": none, "start": none, "length": none, "offset": none, "anchor": none, "content": none}
    if len(data) < length:
        return empty
    _, _, h32, h64 = gram_hashes(data, 64)
    bits = np.uint64(int(len(data)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h32 & ~low) | np.arange(len(h32), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - width :])
    anchor = (least & low).astype(np.int64)  # of the string at each place
    step = np.zeros(len(anchor) + 1, np.int32)
    fits = np.diff(offsets) >= length
    np.add.at(step, offsets[:-1][fits], 1)
    np.add.at(step, offsets[1:][fits] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    at, n = np.flatnonzero(new), np.flatnonzero(last) + length
    if not len(at):
        return empty
    n -= at
    content = _mix(h64[at] * M1 + h64[at + (n - 64) // 2] * M2 + h64[at + n - 64] * M3 + n.astype(np.uint64))
    document = np.searchsorted(offsets, at, side="right") - 1
    return {"document": document, "start": at - offsets[document], "length": n, "offset": anchor[at] - at, "anchor": h32[anchor[at]].view(np.int64), "content": content.view(np.int64)}


PLACES = "kind byte, anchor long, content long, doc_id long, tag long, start long, length int, offset short"


def tagged(docs: DataFrame) -> DataFrame:
    """``texts`` with ``tag``, 64 bits of the text: with the id it tells rows apart that share an id or have none."""
    return texts(docs).withColumn("tag", F.xxhash64("text"))


def places(docs: DataFrame, length: int, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Segments (kind 0), one of each content in a chunk; and what a chunk shows to be repeated (kind 1)."""
    types = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int16())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, chunk_bytes):
                with np.errstate(over="ignore"):
                    data, offsets = buffers(piece["text"])
                    s = segments(data, offsets, length)
                    ids, tags = np.asarray(piece["doc_id"]), np.asarray(piece["tag"])
                    doc_id, tag = ids[s["document"]], tags[s["document"]]
                    order = np.lexsort((s["start"], tag, doc_id, s["content"], s["anchor"]))
                    same = np.append(False, (s["anchor"][order][1:] == s["anchor"][order][:-1]) & (s["content"][order][1:] == s["content"][order][:-1]))
                    # A repeated row is not its own repeat: it shares place and id with the first.
                    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                    twin = same & (doc_id[order] == doc_id[head]) & (tag[order] == tag[head]) & (s["start"][order] == s["start"][head])
                    gone = np.zeros(len(order), bool)
                    gone[order[same & ~twin]] = True
                    sent = np.zeros(len(order), bool)
                    sent[order[~same]] = True
                    at = np.flatnonzero(sent)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int8)), *(pa.array(x[at]) for x in (s["anchor"], s["content"], doc_id)), pa.array(tag[at]), pa.array(s["start"][at]), pa.array(s["length"][at].astype(np.int32)), pa.array(s["offset"][at].astype(np.int16))], schema=types)
                    # Neighbouring repeats of a document are one interval.
                    at = np.flatnonzero(gone)
                    if len(at):
                        first = np.append(True, (np.diff(at) > 1) | (s["document"][at][1:] != s["document"][at][:-1]))
                        a, b = at[first], at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)]
                        size = s["start"][b] + s["length"][b] - s["start"][a]
                        route = _mix(doc_id[a].astype(np.uint64) * M1 + tag[a].astype(np.uint64) * M3 + s["start"][a].astype(np.uint64) * M2).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int8)), pa.array(route), pa.array(np.arange(len(a))), pa.array(doc_id[a]), pa.array(tag[a]), pa.array(s["start"][a]), pa.array(size.astype(np.int32)), pa.array(np.zeros(len(a), np.int16))], schema=types)

    return tagged(docs).mapInArrow(cut, PLACES)


def _least_between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for each pair a < b."""
    out, left, table, width = np.empty(len(a), lcp.dtype), np.arange(len(a)), lcp, 1
    while len(left):  # table[i] is the least of ``width`` entries from i on
        now = (b - a)[left] < 2 * width
        done, left = left[now], left[~now]
        out[done] = np.minimum(table[a[done] + 1], table[b[done] - width + 1])
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def column_sort(group: np.ndarray, symbols: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` symbols repeat an earlier one at the same column of their group.

    ``symbols``: segments by columns, -1 outside of a segment; ``rank`` orders segments within
    a group. The result has a flag for each segment and column.
    """
    n, width = symbols.shape
    order, lcp = np.arange(n), np.zeros(n, np.int32)
    flags = np.zeros((n, width), bool)
    for column in range(width - 1, -1, -1):
        symbol = symbols[order, column].astype(np.int64)
        key = group[order] * 512 + symbol + 1
        step = np.argsort(key, kind="stable")
        a, b = step[:-1], step[1:]
        same = (key[a] == key[b]) & (symbol[b] >= 0)
        new = np.zeros(n, np.int32)
        near = np.flatnonzero(same & (b == a + 1))
        new[near + 1] = lcp[b[near]] + 1
        far = np.flatnonzero(same & (b != a + 1))
        if len(far):
            new[far + 1] = _least_between(lcp, a[far], b[far]) + 1
        order, lcp = order[step], new
        if column + length <= width and (long := lcp >= length).any():
            start = np.flatnonzero(~long)
            first = np.minimum.reduceat(rank[order], start)
            later = rank[order] > np.repeat(first, np.diff(np.append(start, n)))
            flags[order[later], column] = True
    return flags


def _sorted_groups(length: int, batch_rows: int = 8192):
    """Reads segments sorted by anchor, doc_id, tag and start; gives the repeated intervals."""
    reach = length - GRAM  # columns left of the anchor
    width = reach + length

    def settle(t: pa.Table) -> pa.RecordBatch:
        anchor, doc_id, tag, start = (np.asarray(t[c]) for c in ("anchor", "doc_id", "tag", "start"))
        offset, size = np.asarray(t["offset"]).astype(np.int64), np.asarray(t["length"]).astype(np.int64)
        data, _ = buffers(t["bytes"])
        column = np.arange(width)
        inside = (column >= (reach - offset)[:, None]) & (column < (reach - offset + size)[:, None])
        symbols = np.full(inside.shape, -1, np.int16)
        symbols[inside] = data
        new_group = np.append(True, anchor[1:] != anchor[:-1])
        new_place = np.append(True, (doc_id[1:] != doc_id[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1])) | new_group
        flags = column_sort(np.cumsum(new_group), symbols, np.cumsum(new_place), length)
        edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        return pa.record_batch({"doc_id": pa.array(doc_id[row]), "tag": pa.array(tag[row]), "start": pa.array(start[row] + a - (reach - offset[row])), "length": pa.array((b - a + length - 1).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= batch_rows:
                t = pa.Table.from_batches(held)
                anchor = np.asarray(t["anchor"])
                whole = int(np.searchsorted(anchor, anchor[-1]))
                if whole:
                    yield settle(t.slice(0, whole).combine_chunks())
                held = t.slice(whole).combine_chunks().to_batches()
                rows = t.num_rows - whole
        if rows:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


GONE = "doc_id long, tag long, start long, length int"


def repeats(docs: DataFrame, length: int = 100, group: int = GROUP) -> DataFrame:
    """Intervals ``(doc_id, tag, start, length)`` of ``docs`` covered by strings of ``length`` bytes that start earlier too; they may overlap."""
    if length < 64:
        raise ValueError("strings of less than 64 bytes aren't filed by this operator")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places(docs, length).repartition(n, "anchor")
    alike = Window.partitionBy("anchor", "content").orderBy("doc_id", "tag", "start")
    ranked = dealt.withColumn("nth", F.rank().over(alike))
    ranked = ranked.withColumn("others", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("anchor")))
    todo = F.when((F.col("kind") == 1) | (F.col("nth") > 1), 0).when(F.col("others") > group, 2).when(F.col("others") > 1, 1)
    marked = materialize(ranked.withColumn("todo", todo.cast("byte")).where("todo IS NOT NULL").select("todo", "anchor", "doc_id", "tag", "start", "length", "offset"))
    gone = marked.where("todo = 0").select("doc_id", "tag", "start", "length")
    own = tagged(docs).repartition(n, "doc_id", "tag")

    def bytes_of(which: int) -> DataFrame:
        wanted = marked.where(F.col("todo") == which).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "start", "length", "offset")).alias("at"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in chunks(batch, 8 << 20):
                    data, offsets = buffers(piece["text"])
                    each, at = piece["at"].flatten(), piece["at"].value_lengths().to_numpy()
                    row = np.repeat(np.arange(piece.num_rows), at)
                    start, size = np.asarray(each.field("start")), np.asarray(each.field("length")).astype(np.int64)
                    flat = data[gather(offsets[row] + start, size)]
                    cuts = pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32))
                    out = pa.Array.from_buffers(pa.binary(), len(row), [None, cuts, pa.py_buffer(flat)])
                    t = pa.RecordBatch.from_arrays([each.field("anchor"), pa.array(np.asarray(piece["doc_id"])[row]), pa.array(np.asarray(piece["tag"])[row]), each.field("start"), each.field("length"), each.field("offset"), out], ["anchor", "doc_id", "tag", "start", "length", "offset", "bytes"])
                    for i in range(0, t.num_rows, 8192):
                        yield t.slice(i, 8192)

        return own.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "at").mapInArrow(cut, "anchor long, doc_id long, tag long, start long, length int, offset short, bytes binary")

    sorted_ = bytes_of(1).repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "tag", "start")
    gone = gone.union(sorted_.mapInArrow(_sorted_groups(length), GONE))
    return gone if marked.where("todo = 2").isEmpty() else gone.union(_by_hash(bytes_of(2), length))


def _by_hash(pieces: DataFrame, length: int) -> DataFrame:
    """The same for segments of anchors with too many: strings meet by a 128-bit hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = [hashlib.blake2b(r["bytes"][i : i + length], digest_size=16).digest() for i in range(r["length"] - length + 1)]
                yield pa.record_batch({"h": pa.array(found, pa.binary()), "doc_id": pa.array([r["doc_id"]] * len(found)), "tag": pa.array([r["tag"]] * len(found), pa.int64()), "start": pa.array([r["start"] + i for i in range(len(found))])})

    strings = materialize(pieces.mapInArrow(cut, "h binary, doc_id long, tag long, start long"))
    place = F.struct("doc_id", "tag", "start")
    first = strings.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    return strings.join(first, "h").where(place != F.col("first")).select("doc_id", "tag", "start", F.lit(length).alias("length"))


def remove_repeats(docs: DataFrame, length: int = 100, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` of each row of ``docs``.

    Null text is empty. Documents are in the order of doc_id, nulls first; rows that share a
    doc_id, or have none, with another text are documents of their own and stand in the order
    of a 64-bit hash of their texts; rows that repeat both are one document, with a result
    row each. A text of any length is taken whole. A null id comes back null; an empty table
    gives an empty result; other columns are not used.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = repeats(docs, length, group).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("gone"))
    own = tagged(docs).repartition(n, "doc_id", "tag")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, 8 << 20):
                data, offsets = buffers(piece["text"])
                each = piece["gone"].flatten()
                row = np.repeat(np.arange(piece.num_rows), piece["gone"].value_lengths().fill_null(0).to_numpy())
                at, size = np.asarray(each.field("start")), np.asarray(each.field("length"))
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, offsets[row] + at, 1)
                np.add.at(step, offsets[row] + at + size, -1)
                out = np.cumsum(step[:-1]) > 0
                total = np.append(0, np.cumsum(out))
                begin = out.copy()
                begin[1:] &= ~out[:-1]
                begin[offsets[:-1][offsets[:-1] < len(data)]] = out[offsets[:-1][offsets[:-1] < len(data)]]
                spans = np.append(0, np.cumsum(begin))
                kept = [data[a:b][~out[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                of = lambda x: pa.array((x[offsets[1:]] - x[offsets[:-1]]).astype(np.int64))
                yield pa.record_batch({"doc_id": piece["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": of(total), "n_spans": of(spans), "kept": pa.array(kept, pa.binary())})

    out = own.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(real_id(), "n_bytes", "n_removed", "n_spans", "kept")


def digests(removed: DataFrame) -> DataFrame:
    """``kept`` as its SHA-256."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
