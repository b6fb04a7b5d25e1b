"""Global distinct-word shuffle: work on each distinct pre-token once, whatever it costs.

``explode`` cuts every document into pre-tokens. What is exploded is kept by column: a block
of a few MB of text holds its distinct pre-tokens, dealt by hash into word shards, and for
each position the number of the pre-token in the block. One shuffle takes words to shards and
positions to blocks; ``per_word`` works on each distinct pre-token of a shard once;
``reassemble`` joins the answers back by block and hands positions and answers to a function.
No group grows with the data: a word occurs once a block in its shard, the shards' number
follows the measured bytes of the text, so that a shard holds the words of half of TASK_BYTES
at most, about, and a block is bounded by its bytes (or one document).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skein.llm.common import buffers, chunks, pack, pieces, pre_tokens, task_count, texts, unpack

BLOCK_BYTES = 16 << 20
SCHEMA = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("docs", pa.binary())])


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Little-endian byte planes; rare high bytes then compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_values(numbers: np.ndarray, values: pa.Array) -> bytes:
    """Ascending numbers, each with a binary value."""
    data, offsets = buffers(values)
    return len(numbers).to_bytes(4, "little") + _planes(np.diff(numbers, prepend=0)).tobytes() + _planes(np.diff(offsets)).tobytes() + data.tobytes()


def unpack_values(payload: bytes) -> tuple[np.ndarray, pa.Array]:
    n = int.from_bytes(payload[:4], "little")
    planes = np.frombuffer(payload, np.uint8, 8 * n, 4).reshape(8, n)
    offsets = np.append(0, np.cumsum(_numbers(planes[4:])))
    return np.cumsum(_numbers(planes[:4])), pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(payload).slice(4 + 8 * n)])


def explode(docs: DataFrame, n_shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(route, block, payload, docs)``: a block's positions (route: the block) and its distinct words of each shard (route: -1 - shard)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            data = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            coded = pieces(data, np.concatenate([h[1] + k for h, k in zip(held, shift, strict=False)])).dictionary_encode()
            number, distinct = np.asarray(coded.indices), coded.dictionary
            # Frequent words get small numbers, equally frequent ones follow in byte order: both compress.
            place = np.empty(len(distinct), np.int64)
            place[np.asarray(pc.sort_indices(distinct))] = np.arange(len(distinct))
            often = np.lexsort((place, -np.bincount(number, minlength=len(distinct))))
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            distinct = distinct.take(pa.array(often))
            block = part << 32 | made
            made += 1
            planes = _planes(rank[number])
            rows = [(block, block, pack(**{f"b{i}": planes[i] for i in range(4)}), pack(doc_id=np.concatenate([h[2] for h in held]), n=np.concatenate([h[3] for h in held])))]
            shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_shards for w in distinct.to_pylist()), np.int64, len(distinct))
            order = np.argsort(shard, kind="stable")
            used, start = np.unique(shard[order], return_index=True)
            for s, of in zip(used, np.split(order, start[1:]), strict=False):
                rows.append((-1 - int(s), block, pack_values(of, distinct.take(pa.array(of))), None))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows[k : k + 64]], schema=SCHEMA)

        for batch in batches:
            for piece in chunks(batch, 2 << 20):
                data, offsets = buffers(piece["text"])
                if held and size + len(data) > block_bytes:
                    yield from flush()
                    held, size = [], 0
                starts, document = pre_tokens(data, offsets)
                held.append((data.copy(), starts, np.array(piece["doc_id"]), np.bincount(document, minlength=piece.num_rows)))
                size += len(data)
        if held:
            yield from flush()

    return texts(docs).mapInArrow(cut, "route long, block long, payload binary, docs binary")


def per_word(dealt: DataFrame, answer: Callable[[list[bytes]], pa.Array]) -> DataFrame:
    """``(block, payload)``: for each block and shard the block's word numbers and ``answer`` (binary) of the words.

    ``answer`` gets the distinct words of a shard in byte order, once each.
    """

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 0:
            return pd.DataFrame({"block": [], "payload": []})
        parts = [unpack_values(p) for p in pdf["payload"]]
        merged = pa.chunked_array([w for _, w in parts]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(merged.dictionary)
        result = answer(merged.dictionary.take(order).to_pylist())
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        place = np.split(place[np.asarray(merged.indices)], np.cumsum([len(n) for n, _ in parts])[:-1])
        return pd.DataFrame({"block": pdf["block"], "payload": [pack_values(n, result.take(pa.array(p))) for (n, _), p in zip(parts, place, strict=True)]})

    return dealt.groupBy("route").applyInPandas(meet, "block long, payload binary")


def reassemble(dealt: DataFrame, answers: DataFrame, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``finish(doc_id, n pre-tokens of each, word numbers in order, answer by word number)``."""

    def join(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return finish(*[np.zeros(0, np.int64)] * 3, pa.array([], pa.large_binary()))
        parts = [unpack_values(p) for p in right["payload"]]
        if parts:
            order = np.argsort(np.concatenate([n for n, _ in parts]))
            answer = pa.chunked_array([a for _, a in parts]).combine_chunks().take(pa.array(order))
        else:
            answer = pa.array([], pa.large_binary())
        head, seq = unpack(left["docs"][0]), unpack(left["payload"][0])
        return finish(np.asarray(head["doc_id"]), np.asarray(head["n"]), _numbers(np.stack([np.asarray(seq[f"b{i}"]) for i in range(4)])), answer)

    return dealt.groupBy("route").cogroup(answers.groupBy("block")).applyInPandas(join, schema)


def run(docs: DataFrame, answer: Callable, finish: Callable, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The three steps. Both consumers read the one shuffle of ``explode``, which Spark reuses, so each task's cut is made once.

    Each consumer skips the other's groups itself: a filter would be pushed below the shuffle and undo that.
    """
    n = task_count(docs)
    dealt = explode(docs, 2 * n, block_bytes).repartition(n, "route")
    return reassemble(dealt, per_word(dealt, answer), finish, schema)
