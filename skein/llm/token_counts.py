"""Operator 10: token counts by trie-shared dynamic programming.

A unigram model over a piece vocabulary segments a pre-token into the pieces with the best
sum of log probabilities. The distinct pre-tokens of a word shard are walked in byte order,
which visits their trie depth first: forward scores live on the current path, and a node's
score is computed once for all pre-tokens that share its prefix. The count at a terminal
node is the pre-token's number of tokens; counts are joined back and summed by document.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import dictionary
from skein.llm.bpe import ranks
from skein.llm.common import buffers, real_id


@cache
def piece_scores(path: str) -> tuple[dict[bytes, float], int]:
    """Log probability of each piece, by a Zipf law over the ranks of a public vocabulary, and the longest piece's length."""
    table = ranks(path)
    total = math.log(sum(1 / (rank + 2.7) for rank in table.values()))
    return {token: -math.log(rank + 2.7) - total for token, rank in table.items()}, max(map(len, table), default=1)


def trie_counts(found: list[bytes], path: str) -> list[int]:
    """Tokens of the best segmentation of each of the sorted, distinct ``found``; ties: fewer tokens.

    Bytes that no piece covers cost the lowest score less ten, one token each.
    """
    scores, longest = piece_scores(path)
    unknown = min(scores.values(), default=0.0) - 10
    best, count = [0.0], [0]
    previous, counts = b"", []
    get = scores.get
    for word in found:
        shared = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, few = best[end - 1] + unknown, count[end - 1] + 1
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    total = best[start] + s
                    if total > top or (total == top and count[start] + 1 < few):
                        top, few = total, count[start] + 1
            best.append(top)
            count.append(few)
        counts.append(count[len(word)])
        previous = word
    return counts


def count_tokens(docs: DataFrame, path: str, block_bytes: int = dictionary.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, max_tokens`` (most tokens of one pre-token) of each row of ``docs``.

    Null text is empty and counts 0; repeated rows and ids give a row each; a null id comes
    back null; an empty table gives an empty result.
    """

    def answer(found: list[bytes]) -> pa.Array:
        return pa.array([n.to_bytes(4, "little") for n in trie_counts(found, path)], pa.binary())

    def finish(doc_id: np.ndarray, n: np.ndarray, seq: np.ndarray, counts: pa.Array) -> pd.DataFrame:
        each = buffers(counts)[0].view("<u4").astype(np.int64)[seq]
        ends = np.cumsum(n)
        total = np.append(0, np.cumsum(each))
        most = np.zeros(len(n), np.int64)
        if (some := n > 0).any():
            most[some] = np.maximum.reduceat(each, (ends - n)[some])
        return pd.DataFrame({"doc_id": doc_id, "n_pretokens": n, "n_tokens": total[ends] - total[ends - n], "max_tokens": most})

    out = dictionary.run(docs, answer, finish, "doc_id long, n_pretokens long, n_tokens long, max_tokens long", block_bytes)
    return out.select(real_id(), "n_pretokens", "n_tokens", "max_tokens")
