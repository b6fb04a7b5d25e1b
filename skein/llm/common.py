"""What the text operators share: column handling, Arrow payloads, word and pre-token cuts."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the pre-token pattern: Unicode's White_Space, as a regex class body.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Stands for a null doc_id inside an operator.
NO_ID = -(2**63)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, text`` (null id: NO_ID, null text: empty) and the columns of ``more`` that exist, else null."""
    own = {c.lower() for c in docs.columns}
    extra = [F.col(c) if c.lower() in own else F.lit(None).cast("string").alias(c) for c in more]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)


#: Bytes of text whose share of a shuffle one task reads, about.
TASK_BYTES = 1 << 30


def task_count(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks of a shuffle of what ``docs`` holds: those of the session, more where the text's bytes ask for more."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))


def row_key(*more):
    """128 bits of a row's doc_id, ``more`` and text, never null: tells apart rows that share an id or have none."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).cast("string")
    return F.unhex(F.md5(F.concat_ws("\0", own, *more, F.coalesce("text", F.lit("")))))


def real_id(name: str = "doc_id"):
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array without nulls; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, limit: int):
    """Slices of ``batch`` of about ``limit`` bytes of text; a longer document stands alone."""
    lengths = np.asarray(pc.binary_length(batch["text"]).cast(pa.int64()))
    total, first = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += int(n)
    if batch.num_rows > first:
        yield batch.slice(first)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """The byte ranges as a large-binary array: the ranges tile ``data`` if ``ends`` is left out."""
    if ends is None:
        offsets = np.append(starts, len(data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    mixed = np.empty(2 * len(starts) + 1, np.int64)
    mixed[0:-1:2], mixed[1::2], mixed[-1] = starts, ends, len(data)
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(mixed), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, document)`` of each word ``[^\\x20\\x09-\\x0D]+``; words stay inside documents."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pack(**columns) -> bytes:
    """Columns of one length as compressed Arrow IPC."""
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_next_batch()


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space, as the pre-token pattern sees them."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(code point, first byte)`` of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    if not len(at) or lead.max() < 0x80:
        return lead, at
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    two, three, four = lead >= 0xC0, lead >= 0xE0, lead >= 0xF0
    cp = lead.copy()
    cp[two] = ((lead[two] & 0x1F) << 6) | (padded[at[two] + 1] & 0x3F)
    cp[three] = ((lead[three] & 0x0F) << 12) | ((padded[at[three] + 1] & 0x3F) << 6) | (padded[at[three] + 2] & 0x3F)
    cp[four] = ((lead[four] & 0x07) << 18) | ((padded[at[four] + 1] & 0x3F) << 12) | ((padded[at[four] + 2] & 0x3F) << 6) | (padded[at[four] + 3] & 0x3F)
    return cp, at


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, document)`` of the pre-tokens of ``public_tokenizers.PATTERN``; they tile ``data``.

    Runs of one character class are the tokens, with the pattern's three rules: a single
    space joins the run that follows; the last character of a longer white-space run is cut
    off if something follows; a contraction splits a run of "other" that an apostrophe ends.
    The first two are array operations; documents with an apostrophe take the pattern itself.
    """
    cp, at = code_points(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    doc_starts = np.zeros(n + 1, bool)
    doc_starts[np.searchsorted(at, offsets[:-1])] = True
    doc_starts[n] = True
    run = np.append(True, kind[1:] != kind[:-1]) | doc_starts[:-1]
    space = kind == 3
    last_space = space & np.append(run[1:], True) & ~doc_starts[1:]
    joined = np.append(False, (cp[:-1] == 32) & last_space[:-1])
    start = (run & ~(joined & ~space)) | last_space
    starts = at[start]
    document = np.searchsorted(offsets, starts, side="right") - 1
    quotes = np.unique(np.searchsorted(offsets, np.flatnonzero(data == 39), side="right") - 1)
    if len(quotes):
        starts, document = starts[keep := ~np.isin(document, quotes)], document[keep]
        found = [_by_pattern(bytes(data[offsets[i] : offsets[i + 1]])) + offsets[i] for i in quotes]
        starts = np.concatenate([starts, *found])
        document = np.concatenate([document, np.repeat(quotes, [len(x) for x in found])])
        order = np.argsort(starts, kind="stable")
        starts, document = starts[order], document[order]
    return starts, document


@cache
def _pattern():
    import public_tokenizers
    import regex

    pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return regex.compile(pattern)


def _by_pattern(text: bytes) -> np.ndarray:
    lengths = [len(m.encode()) for m in _pattern().findall(text.decode())]
    return np.cumsum([0, *lengths[:-1]], dtype=np.int64)
