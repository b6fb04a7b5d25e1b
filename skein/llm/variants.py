"""Operator 11: spelling variants found with a frequency-vector trie.

A word's vector counts its code points by letter group; a trie holds the words by successive
counts. One inserted, deleted or replaced code point raises at most one count by one and
lowers at most one by one, so a search for near words walks the trie with a surplus and a
deficit of one each to spend, and verifies the words of the leaves that it comes to.

The trie is cut into cells: subtrees that hold no more than ``cell_words`` words (at the
smallest depth where that is so), found by counting prefixes; a leaf that holds more is dealt
into blocks. The cells' own trie is small (its size is bounded, see ``directory``) and every
task walks it to learn which cells a word has to visit. A word is stored in its own cell and
visits only cells that come later in order, so each pair meets once. Cells stream: what is
stored is held, visitors pass by in batches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, texts
from skein.sources.scratch import materialize

GROUPS = 16
LEAST_POINTS, LEAST_COUNT = 5, 3
#: A run loses a code point if this divides its hash.
SLIP = 97
#: The runs of ``[A-Za-zÀ-ÿ]`` that are long enough, in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_POINTS)
#: Words longer than this are compared one pair at a time.
WIDE = 64


def runs_of(doc_id: int, text: str) -> Counter:
    """How often each word (UTF-8) occurs in a text, one code point of some runs deleted."""
    found = Counter(RUN.findall(text.encode().lower()))
    start = zlib.crc32(b":" if doc_id == NO_ID else b"%d:" % doc_id)
    cut = {r: found.pop(r) for r in [r for r in found if not zlib.crc32(r, start) % SLIP]}
    for run, n in cut.items():
        word = run.decode()
        at = zlib.crc32(run, start) % len(word)
        found[(word[:at] + word[at + 1 :]).encode()] += n
    return found


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, held: int = 400_000) -> DataFrame:
    """``word, n`` of all words of enough code points that occur ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            own = [w for w in total if len(w) >= 2 * LEAST_POINTS or len(w.decode()) >= LEAST_POINTS]
            return pa.record_batch({"word": pa.array(own, pa.binary()).cast(pa.string()), "n": pa.array([total[w] for w in own], pa.int64())})

        total = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                total.update(runs_of(doc_id, text.as_py()))
                if len(total) > held:
                    yield rows()
                    total = Counter()
        yield rows()

    counted = texts(docs).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words (each fits a byte), one word after the other, and where words start."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(coded), np.uint8), np.append(0, np.cumsum([len(w) for w in coded], dtype=np.int64))


def vectors(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(words, GROUPS)``: how many code points of each group a word has."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(owner * GROUPS + flat % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


class Trie:
    """Distinct count vectors (or their prefixes, filled up with -1) in order, level by level."""

    def __init__(self, vecs: np.ndarray):
        self.vecs, self.leaf = np.unique(vecs, axis=0, return_inverse=True)
        self.leaf = self.leaf.reshape(-1)
        n, self.levels = len(self.vecs), []
        new, node = np.zeros(n, bool), np.zeros(n, np.int64)
        new[:1] = True
        for depth in range(GROUPS):
            parent = node
            if n:
                new[1:] |= self.vecs[1:, depth] != self.vecs[:-1, depth]
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            at = np.searchsorted(parent[first], np.arange((parent[-1] + 1 if n else 0) + 1))
            self.levels.append((at, self.vecs[first, depth]))  # a node's children, and each child's count
        self.n = n

    def near(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(probe, leaf)`` of all leaves that a surplus and a deficit of one each reach."""
        row = np.arange(len(probes) if self.n else 0)
        node, more, less = np.zeros(len(row), np.int64), np.ones(len(row), np.int8), np.ones(len(row), np.int8)
        for depth, (at, count) in enumerate(self.levels):
            n = at[node + 1] - at[node]
            ends = np.cumsum(n)
            child = np.repeat(at[node] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            row, more, less = np.repeat(row, n), np.repeat(more, n), np.repeat(less, n)
            apart = np.where(count[child] < 0, 0, count[child] - probes[row, depth])  # -1: the prefix has ended
            more, less = more - (apart == 1), less - (apart == -1)
            ok = (np.abs(apart) <= 1) & (more >= 0) & (less >= 0)
            row, node, more, less = row[ok], child[ok], more[ok], less[ok]
        return row, node


def directory(words: DataFrame, cell_words: int) -> np.ndarray:
    """The cells' prefixes, one a row, filled up with -1, in order.

    A cell's parent holds more than the limit, and the limit is at least a ten-thousandth of
    all words; so there are at most 10,000 parents a level, each with as many cells as the
    next group has different counts.
    """
    vec = words.groupBy("vec").count()
    total = vec.agg(F.sum("count")).first()[0] or 0
    limit = max(cell_words, total // 10_000)
    if total <= limit:
        return np.full((1, GROUPS), -1, np.int32)
    depth = F.explode(F.sequence(F.lit(1), F.lit(GROUPS))).alias("depth")
    prefix = vec.select("vec", "count", depth).groupBy("depth", F.slice("vec", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("count").alias("n"))
    prefix = materialize(prefix)
    over = prefix.where(F.col("n") > limit).select(F.col("prefix").alias("parent")).union(words.sparkSession.createDataFrame([([],)], "parent array<int>"))
    cells = prefix.where((F.col("n") <= limit) | (F.col("depth") == GROUPS)).join(over, F.expr("slice(prefix, 1, depth - 1) = parent"), "left_semi")
    return np.array(sorted(r.prefix + [-1] * (GROUPS - len(r.prefix)) for r in cells.select("prefix").collect()), np.int32)


def one_edit(a: str, b: str) -> bool:
    """Whether the two differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == b[k + (len(a) == len(b)) :]


def _rows(flat: np.ndarray, starts: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Code points of the words ``of``, one a row, filled up with zeros."""
    length = np.diff(starts)[of]
    out = np.zeros((len(of), width), np.uint8)
    inside = np.arange(width) < length[:, None]
    out[inside] = flat[(starts[of][:, None] + np.arange(width))[inside]]
    return out


class Words:
    """Words with their counts, code points and vectors."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.words, self.n = words, n
        self.flat, self.starts = points(words)
        self.length = np.diff(self.starts)
        self.vec = vectors(self.flat, self.starts)

    def verified(self, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart."""
        out = np.zeros(len(i), bool)
        apart = self.length[i] - other.length[j]
        long = np.maximum(self.length[i], other.length[j])
        for width in (16, WIDE):
            for shift in (-1, 0, 1):
                at = np.flatnonzero((apart == shift) & (long <= width) & (long > (0 if width == 16 else 16)))
                for k in range(0, len(at), 1 << 18):
                    own = at[k : k + (1 << 18)]
                    a, b = _rows(self.flat, self.starts, i[own], width), _rows(other.flat, other.starts, j[own], width)
                    if not shift:
                        out[own] = (a != b).sum(1) == 1
                        continue
                    if shift < 0:
                        a, b = b, a
                    first = (a != b).argmax(1)  # the longer word goes on, so there is one
                    late = a[:, 1:] != b[:, :-1]
                    last = np.where(late.any(1), width - 2 - late[:, ::-1].argmax(1), -1)
                    out[own] = last < first
        for k in np.flatnonzero((long > WIDE) & (np.abs(apart) <= 1)):
            out[k] = one_edit(self.words[int(i[k])].as_py(), other.words[int(j[k])].as_py())
        return out


class Tally:
    """How many near words each word has met, and the most frequent of them (ties: smallest)."""

    def __init__(self, of: Words):
        self.of, self.near = of, np.zeros(len(of.n), np.int64)
        self.best_n, self.best = np.zeros(len(of.n), np.int64), [None] * len(of.n)

    def add(self, i: np.ndarray, other: Words, j: np.ndarray) -> None:
        self.near += np.bincount(i, minlength=len(self.near))
        if not len(i):
            return
        order = np.lexsort((-other.n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        tied = other.n[j] == np.repeat(other.n[j[first]], np.diff(np.append(first, len(i))))
        for w, x in zip(i[tied].tolist(), j[tied].tolist(), strict=True):
            n, word = int(other.n[x]), other.words[x].as_py()
            if n > self.best_n[w] or (n == self.best_n[w] and word < self.best[w]):
                self.best_n[w], self.best[w] = n, word

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.near)
        return pa.record_batch({"word": self.of.words.take(pa.array(some)), "near": pa.array(self.near[some]), "best_n": pa.array(self.best_n[some]), "best": pa.array([self.best[k] for k in some], pa.string())})


def _meet(stored: Words, trie: Trie, by_leaf: np.ndarray, at: np.ndarray, probes: Words, same: bool, batch: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(probe, stored)`` pairs one edit apart; within one set each pair once."""
    own = Trie(probes.vec)
    order = np.argsort(own.leaf, kind="stable")
    ends = np.searchsorted(own.leaf[order], np.arange(own.n + 1))
    for k in range(0, own.n, 2048):
        p, leaf = trie.near(own.vecs[k : k + 2048])
        p += k
        size = (ends[p + 1] - ends[p]) * (at[leaf + 1] - at[leaf])
        done = np.cumsum(size)
        cuts = np.searchsorted(done, np.arange(batch, done[-1] if len(done) else 0, batch))
        for part in np.split(np.arange(len(p)), np.unique(cuts)):
            # One leaf may have more pairs than a batch: its probes go in slices.
            for a, b, c, d in _slices(ends[p[part]], ends[p[part] + 1], at[leaf[part]], at[leaf[part] + 1], batch):
                n, m = b - a, d - c
                pairs = np.repeat(np.arange(len(n)), n * m)
                place = np.arange(len(pairs)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                i, j = order[a[pairs] + place // m[pairs]], by_leaf[c[pairs] + place % m[pairs]]
                if same:
                    i, j = i[i < j], j[i < j]
                ok = probes.verified(i, stored, j)
                yield i[ok], j[ok]


def _slices(a, b, c, d, batch):
    total = int(((b - a) * (d - c)).sum())
    if total <= 2 * batch or len(a) > 1:
        if total <= 4 * batch:
            yield a, b, c, d
            return
        for k in range(len(a)):
            yield from _slices(a[k : k + 1], b[k : k + 1], c[k : k + 1], d[k : k + 1], batch)
        return
    for x in range(int(c[0]), int(d[0]), 1 << 14):
        y, step = np.array([min(int(d[0]), x + (1 << 14))]), max(1, batch >> 14)
        for z in range(int(a[0]), int(b[0]), step):
            yield np.array([z]), np.array([min(int(b[0]), z + step)]), np.array([x]), y


def near_words(words: DataFrame, cell_words: int = 1 << 15) -> DataFrame:
    """``word, n_near, form, form_n`` of each word of ``words`` (``word, n``, distinct) that has a near word; ``form`` is the likeliest, of whatever ``n``."""

    def with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"vec": pa.array(vectors(*points(b["word"])).tolist(), pa.list_(pa.int32()))})

    cells = directory(words.select("word").mapInArrow(with_vector, "vec array<int>"), cell_words)
    trie = Trie(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = Trie(vectors(*points(b["word"])))
            i, cell = trie.near(own.vecs)
            home = np.zeros(own.n, np.int64)
            inside = (trie.vecs[cell] < 0) | (trie.vecs[cell] == own.vecs[i])
            home[i[inside.all(1)]] = cell[inside.all(1)]
            i, cell = i[cell >= home[i]], cell[cell >= home[i]]
            order = np.argsort(own.leaf, kind="stable")
            ends = np.searchsorted(own.leaf[order], np.arange(own.n + 1))
            n = ends[i + 1] - ends[i]
            pair = np.repeat(np.arange(len(i)), n)
            row = order[ends[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            yield pa.record_batch({"cell": pa.array(cell[pair]), "home": pa.array(home[i][pair]), "word": b["word"].take(pa.array(row)), "n": b["n"].take(pa.array(row))})

    dealt = words.select("word", "n").mapInArrow(deal, "cell long, home long, word string, n long")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if (cells[:, -1] >= 0).any():
        dealt = _blocks(materialize(dealt), cell_words)
    else:
        dealt = dealt.select("cell", F.lit(0).alias("block"), (F.col("cell") > F.col("home")).alias("visits"), "word", "n")
    dealt = dealt.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "visits")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, stored, tally = None, [], None, None

        def close_stored():
            nonlocal stored, tally, held, index
            stored = Words(pa.concat_arrays([h["word"] for h in held]), np.concatenate([np.asarray(h["n"]) for h in held]))
            held = []
            t = Trie(stored.vec)
            by_leaf = np.argsort(t.leaf, kind="stable")
            index = t, by_leaf, np.searchsorted(t.leaf[by_leaf], np.arange(t.n + 1))
            tally = Tally(stored)
            for i, j in _meet(stored, *index, stored, same=True):
                tally.add(np.append(i, j), stored, np.append(j, i))

        index = None
        for b in batches:
            cell, block, visits = (np.asarray(b[c]) if c != "visits" else b[c].to_numpy(zero_copy_only=False) for c in ("cell", "block", "visits"))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if s == e:
                    continue
                piece = b.slice(s, e - s)
                if key != (cell[s], block[s]):
                    if held:
                        close_stored()
                    if tally is not None:
                        yield tally.rows()
                    key, held, stored, tally = (cell[s], block[s]), [], None, None
                if not visits[s]:
                    held.append(piece)
                    continue
                if stored is None:
                    if not held:
                        continue  # nobody lives there
                    close_stored()
                probes = Words(piece["word"], np.asarray(piece["n"]))
                own = Tally(probes)
                for i, j in _meet(stored, *index, probes, same=False):
                    own.add(i, stored, j)
                    tally.add(j, probes, i)
                yield own.rows()
        if held:
            close_stored()
        if tally is not None:
            yield tally.rows()

    met = dealt.mapInArrow(search, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def _blocks(dealt: DataFrame, cell_words: int) -> DataFrame:
    """Cells that can't be cut any further, dealt into blocks; visitors and residents of earlier blocks visit each later one."""
    size = dealt.where("cell = home").groupBy("cell").count().select("cell", F.ceil(F.col("count") / cell_words).cast("int").alias("blocks"))
    own = F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).otherwise(F.lit(-1))
    each = dealt.join(size, "cell").withColumn("own", own)
    each = each.withColumn("block", F.explode(F.sequence(F.greatest("own", F.lit(0)), F.col("blocks") - 1)))
    return each.select("cell", "block", (F.col("block") > F.col("own")).alias("visits"), "word", "n")


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``word, root`` of each word with a form: the end of its chain. Each round doubles the steps taken; a form's count at least doubles, so chains are short and end."""
    found = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found
    raise RuntimeError("the chains didn't end")


def variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = 2, cell_words: int = 1 << 15) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs`` that occurs ``least`` times or more.

    ``form`` is the near word (one edit) of largest ``n`` (ties: smallest in code-point order)
    if that is ``ratio`` times the word's own or more; ``root`` the last of the chain of forms.
    Null text has no words; a null id hashes as an empty one; repeated rows count again; runs
    of any length are words; other columns are not looked at; an empty table gives an empty
    result.
    """
    words = materialize(vocabulary(docs, least))
    near = near_words(words, cell_words)
    fits = F.col("form_n") >= ratio * F.col("n")
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    near = materialize(near)
    root = roots(near.where("form IS NOT NULL"))
    return near.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
