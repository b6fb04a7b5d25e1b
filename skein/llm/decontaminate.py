"""Operator 8: benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are canonicalised: punctuation and case go, numbers,
names and units become typed placeholders. Windows of canonical words are joined by hash, so
a question with other numbers or names still meets its template. A window of which less than
half are literal words says too little as a template (eight numbers in a row are a window of
any list): it is met by its very words only. A meeting counts if the
slots agree: one value of the item stands for one value in the document and the other way
round. Hash windows that no item has never leave their scan task while the benchmark's
hashes fit a checked limit; beyond it they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import buffers, chunks, pieces, real_id, row_key, texts, words
from skein.sources.scratch import fresh, materialize

#: Fixed lists of the canonicalisation.
UNITS = ["kg", "g", "mg", "t", "lb", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h", "hr", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "week", "weeks", "year", "years", "meter", "meters", "metre", "metres", "mile", "miles", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent", "degree", "degrees", "w", "kw", "v", "hz", "mb", "gb"]
#: Number words from two on, in English, German, French and Spanish; "once" is left out, which is English for something else.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille dos tres cuatro cinco seis siete ocho nueve diez doce veinte cien mil".split()
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>=_-+/\\~`^"
NUMBER = r"^[+-]?[0-9]([0-9.,:/]*[0-9])?$"
NAME = r"^\p{Lu}\p{Ll}"
#: Placeholders' hashes.
NUM, NAM, UNIT = (xxhash.xxh3_64_intdigest(f"\0{x}") for x in ("number", "name", "unit"))
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Share of a window's words that must be literal for its template to count, and words of the shortest item that a sentence can give away.
LITERAL, SENTENCE = 0.5, 3
#: Windows of the benchmark that may be broadcast (8 bytes each), and words of a window.
BROADCAST, WINDOW = 2_000_000, 8
#: Least share of an item's windows that a document must hold.
COVERAGE = 0.1


def canonical(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each word with a letter or digit: document, hash, kind (0 word, 1 number, 2 name, 3 unit) and hash of its value."""
    starts, ends, document = words(data, offsets)
    coded = pieces(data, starts, ends).dictionary_encode()
    number, raw = np.asarray(coded.indices), coded.dictionary.cast(pa.large_string())
    core = pc.utf8_trim(raw, PUNCTUATION)
    lower = pc.utf8_lower(core)
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, lower.to_pylist()), np.uint64, len(lower))
    numeric, named = np.asarray(pc.or_(pc.match_substring_regex(core, NUMBER), pc.is_in(lower, pa.array(NUMBER_WORDS, pa.large_string())))), np.asarray(pc.match_substring_regex(core, NAME))
    unit, stop = np.asarray(pc.is_in(lower, pa.array(UNITS, pa.large_string()))), np.asarray(pc.match_substring_regex(raw, r"[.!?:]\W*$"))
    full = np.asarray(pc.not_equal(core, ""))
    # The first word of a text or line, or after a stop, has its capital from there.
    after = np.zeros(len(starts), bool)
    breaks = np.cumsum(data == 10)
    after[1:] = ~stop[number[:-1]] & (document[1:] == document[:-1]) & (breaks[starts[1:]] == breaks[starts[:-1]])
    keep = full[number]
    number, document, after = number[keep], document[keep], after[keep]
    kind = np.where(numeric[number], 1, np.where(named[number] & after, 2, 0))
    counted = np.append(False, (kind[:-1] == 1) & (document[1:] == document[:-1]))
    kind[(kind == 0) & counted & unit[number]] = 3
    own = value[number]
    # Sentences start at the first word of a text or line, or after a stop.
    first = ~after
    return {"document": document, "first": first, "last": np.append(first[1:], True) if len(first) else first, "hash": np.choose(kind, [own, np.uint64(NUM), np.uint64(NAM), np.uint64(UNIT)]).astype(np.uint64), "kind": kind, "value": own}


def _rolled(h: np.ndarray, values: np.ndarray, template: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each of ``at``: of their canonical forms, or of the words themselves where the template says too little."""
    key = np.where(template, np.uint64(n), np.uint64(n) << np.uint64(32))
    for i in range(n):
        key = (key ^ np.where(template, h[at + i], values[at + i])) * STEP
        key ^= key >> np.uint64(29)
    return key


def _windows(c: dict[str, np.ndarray], n_docs: int, sizes: list[int], least: int, short: bool, known: np.ndarray | None, wanted: np.ndarray | None) -> pa.Table:
    """``(document, at, n, hash, slots)`` of windows; with ``known`` and ``wanted`` only those that can meet an item.

    ``short``: texts with fewer words than the largest size have one window, the whole text.
    """
    h, document = c["hash"], c["document"]
    per = np.bincount(document, minlength=n_docs)
    first = np.cumsum(per) - per
    found, literal = [], np.append(0, np.cumsum(c["kind"] == 0))
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(h) < n:
                continue
            ok = document[: len(h) - n + 1] == document[n - 1 :]
            if short and n < max(sizes):
                ok &= per[document[: len(h) - n + 1]] == n
            elif n < least:  # too short to be told from chance: it must be a sentence, or all of the document
                alone = per[document[: len(h) - n + 1]] == n
                ok &= alone | (c["first"][: len(h) - n + 1] & c["last"][n - 1 :]) if n >= SENTENCE else alone
            if known is not None:
                there = np.append(0, np.cumsum(known))
                ok &= there[n:] - there[:-n] == n
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            key = _rolled(h, c["value"], literal[at + n] - literal[at] >= LITERAL * n, at, n)
            if wanted is not None and len(wanted):
                place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                at, key = at[m := wanted[place] == key], key[m]
            found.append((at, np.full(len(at), n), key))
    if not found:
        return None
    at, n, key = (np.concatenate(x) for x in zip(*found, strict=True))
    slots = [[int(v) for v in c["value"][a : a + k][c["kind"][a : a + k] > 0].view(np.int64)] for a, k in zip(at, n, strict=True)] if (c["kind"] > 0).any() else [[]] * len(at)
    return pa.table({"row": pa.array(document[at]), "at": pa.array((at - first[document[at]]).astype(np.int32)), "n": pa.array(n.astype(np.int32)), "hash": pa.array(key.view(np.int64)), "slots": pa.array(slots, pa.list_(pa.int64()))})


SCHEMA = "id long, at int, n int, hash long, slots array<long>"


def _cut(id_name: str, sizes: list[int], least: int, short: bool, share=None, chunk_bytes: int = 4 << 20):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_set, wanted = share.value if share is not None else (None, None)
        for batch in batches:
            for piece in chunks(batch, chunk_bytes):
                c = canonical(*buffers(piece["text"]))
                known = None
                if known_set is not None:
                    place = np.minimum(np.searchsorted(known_set, c["hash"]), len(known_set) - 1)
                    known = known_set[place] == c["hash"]
                t = _windows(c, piece.num_rows, sizes, least, short, known, wanted)
                if t is not None and t.num_rows:
                    t = t.set_column(0, "id", piece[id_name].take(t["row"].combine_chunks()))
                    yield from t.cast(pa.schema([("id", piece[id_name].type), ("at", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))])).to_batches()

    return cut


def meetings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = 5, broadcast: int = BROADCAST, by_row: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, n_item_windows, coverage`` of each document and item that share a consistent window.

    ``by_row``: ``row_key`` takes the place of ``doc_id``, so that rows of one id, or of none, stay apart.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), "text")
    sizes = list(range(1, window + 1))
    bench = materialize(texts(items).mapInArrow(_cut("doc_id", sizes, 0, True), SCHEMA))
    share = None
    if 0 < bench.count() <= broadcast:
        # Bounded by ``broadcast`` windows of at most ``window`` word hashes each.
        hashes = texts(items).mapInArrow(_hashes, "hash long").distinct().toPandas()["hash"].to_numpy()
        wanted = bench.select("hash").distinct().toPandas()["hash"].to_numpy()
        share = bench.sparkSession.sparkContext.broadcast((np.sort(hashes.view(np.uint64)), np.sort(wanted.view(np.uint64))))
    used = sorted(r[0] for r in bench.select("n").distinct().collect())
    schema = SCHEMA.replace("id long", "id binary") if by_row else SCHEMA
    rows = texts(docs).select(row_key().alias("id"), "text") if by_row else texts(docs).withColumnRenamed("doc_id", "id")
    met = rows.mapInArrow(_cut("id", used, least, False, share), schema) if used else bench.limit(0)
    b = bench.select("hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("said"))
    # Windows at one distance between item and document are one meeting: their slots must agree as a whole.
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    pairs = distinct(F.arrays_zip("slots", "said"))
    met = met.join(b, "hash").groupBy("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    hit = met.agg((pairs == distinct("slots")).alias("one"), (pairs == distinct("said")).alias("other"), F.collect_set("item_at").alias("places"))
    hit = hit.where("one AND other").select("id", "item_id", F.explode("places").alias("item_at"))
    count = bench.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("n_item_windows"))
    out = hit.groupBy("id", "item_id").agg(F.countDistinct("item_at").alias("n_windows")).join(count, "item_id")
    own = F.col("id").alias("row_key") if by_row else real_id("id").alias("doc_id")
    return out.select(own, "item_id", "n_windows", "n_item_windows", F.round(F.col("n_windows") / F.col("n_item_windows"), 6).alias("coverage"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = canonical(*buffers(batch["text"]))
        yield pa.record_batch({"hash": pa.array(np.unique(c["hash"]).view(np.int64))})


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``meetings`` of ``coverage`` or more: the documents that hold a benchmark passage, with the items.

    A text of fewer than ``window`` words is one window; an item of three or four words is met
    by a sentence that is just that, one of fewer words only by a document that has no others.
    A text of any length is read whole. Null text has no words; a null item_id or
    doc_id comes back null; repeated rows of a document count once; an empty table on either
    side gives an empty result; other columns are not used.
    """
    return meetings(docs, benchmark, window).where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage.

    A row is judged by its own id and text: rows without an id, or of one id, do not decide for
    each other; repeated rows stay or go together; null and empty texts and those of an empty
    benchmark stay; a text of any length is read whole; a column of any name may be there.
    """
    met = meetings(docs, benchmark, window, by_row=True).where(F.col("coverage") >= coverage)
    bad = met.select(F.col("row_key").alias(key := fresh(docs, "leaked_key"))).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*docs.columns)
