"""Operator 9: byte-level BPE encoding and decoding over a global distinct-word shuffle.

The distinct pre-tokens of the corpus are encoded once each; their ids are joined back by
block and laid out by position. Decoding joins the ids with the token-byte table, which is
as large as the vocabulary file and no larger, so every task holds it whole.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import dictionary
from skein.llm.common import buffers, real_id


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: the bytes of all tokens by id, and where each one starts."""
    by_id = {rank: token for token, rank in ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def decode(ids: np.ndarray, path: str) -> bytes:
    """Bytes of a list of ids."""
    data, starts = token_bytes(path)
    ids = np.asarray(ids, np.int64)
    return data[gather(starts[ids], starts[ids + 1] - starts[ids])].tobytes()


def encode(docs: DataFrame, path: str, block_bytes: int = dictionary.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids binary`` (little-endian unsigned 32-bit) ``, decoded binary`` of each row of ``docs``.

    Null text is empty; an empty text has no tokens; repeated rows and repeated ids give a
    row each; a null id comes back null; other columns are not looked at; an empty table
    gives an empty result.
    """

    kind = np.dtype("<u2" if max(ranks(path).values(), default=0) < 1 << 16 else "<u4")  # of a stored id

    def answer(found: list[bytes]) -> pa.Array:
        table, single = ranks(path), encoding(path)._encode_single_piece
        ids = [[t] if (t := table.get(w)) is not None else single(w) for w in found]
        return pa.array([np.array(x, kind).tobytes() for x in ids], pa.binary())

    def finish(doc_id: np.ndarray, n: np.ndarray, seq: np.ndarray, ids: pa.Array) -> pd.DataFrame:
        flat, starts = buffers(ids)
        flat, starts = flat.view(kind), starts // kind.itemsize
        rows, first = [], 0
        for d, k in zip(doc_id, n, strict=True):
            own = seq[first : first + k].astype(np.int64)
            first += k
            out = flat[gather(starts[own], starts[own + 1] - starts[own])].astype("<u4")
            rows.append((d, len(out), out.tobytes(), decode(out, path)))
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids", "decoded"])

    out = dictionary.run(docs, answer, finish, "doc_id long, n_tokens long, ids binary, decoded binary", block_bytes)
    return out.select(real_id(), "n_tokens", "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference(text: str | None, path: str) -> tuple[int, str, str]:
    """Brute force of a row: the tiktoken library itself."""
    ids = encoding(path).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(encoding(path).decode_bytes(ids)).hexdigest()
