"""Spelling variants, nearest neighbours and collocations against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import collocations, projections, variants

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, word string, w1 long, n long, cell long"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- spelling variants


def brute_variants(rows, least=3, ratio=2):
    n = Counter()
    for doc_id, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}
    wild = defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            wild[w[:i] + "?" + w[i:]].add(w)
            if i < len(w):
                wild[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    out = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= ratio * n[w] else None
        out[w] = form, n[w], len(near[w]), n.get(form)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, o[0], root(w), *o[1:]) for w, o in out.items())


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("cell_words", [1 << 15, 300, 10])
def test_variants_match_brute_force(spark, small, cell_words):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    want = brute_variants(rows)
    assert len(want) > 2000 and variant_rows(variants.variants(small, cell_words=cell_words)) == want


def odd_documents():
    rng = random.Random(4)
    base = ["colour", "color", "colours", "Ünïcöde", "ünicöde", "aaaaa", "aaaaaa", "ab" * 60, "ab" * 60 + "a", "ab" * 59 + "bb", "straße", "strasse", "x÷y×zw", "kitten"]
    texts = [None, "", " \t\n", "tiny", " ".join(rng.choice(base) for _ in range(400)), " ".join(rng.choice(base) for _ in range(9000)), "colour color color", "colour"]
    # Words of two letters in every order: one vector holds very many.
    texts.append(" ".join("".join(rng.sample("aaaaabbbb", 9)) for _ in range(1500)))
    rows = [(i, t, None if i % 3 else "en", "w", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[4], "en", "w", 1, 2, 3), (4, "colours " * 5, "en", None, None, None, None)]


@pytest.mark.parametrize("cell_words", [1 << 15, 20])
def test_variants_of_awkward_rows(spark, cell_words):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    assert variant_rows(variants.variants(docs, cell_words=cell_words)) == brute_variants([r[:2] for r in rows])
    assert variants.variants(docs.where("false")).collect() == []


def test_one_edit_by_definition():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abc" for k in (0, 1)}
        assert variants.one_edit(a, b) == (b in edits - {a})


def test_pairs_at_both_widths():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (5, 6, 15, 16, 17, 62, 63, 64, 65, 66) for _ in range(12)})
    words += [w[:k] + w[k + 1 :] for w in words for k in (0, len(w) // 2, len(w) - 1)] + [w[:-1] + "c" for w in words]
    words = sorted({w for w in words if len(w) > 4})
    own = variants.Words(pa.array(words), np.ones(len(words), np.int64))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    ok = own.verified(i, own, j)
    assert ok.tolist() == [variants.one_edit(words[a], words[b]) for a, b in zip(i, j)]
    # The trie reaches every such pair.
    trie = variants.Trie(own.vec)
    p, leaf = trie.near(own.vec)
    reached = set(zip(p.tolist(), leaf.tolist()))
    assert all((a, trie.leaf[b]) in reached for a, b in zip(i[ok].tolist(), j[ok].tolist()))


# --- nearest neighbours


def brute_neighbours(rows, k=20, every=20):
    """Per query the ``(vec_id, score)`` of all candidates, nearest first; rows are distinct (id, vector)."""
    ids, x = [r[0] for r in rows], [r[1] for r in rows]
    out = []
    for a, query in enumerate(ids):
        if query is None or query % every:
            continue
        scores = []
        for b, other in enumerate(ids):
            if b != a:
                s = 0.0
                for u, w in zip(x[a], x[b]):
                    s += u * w
                scores.append((-s, -(2**63) if other is None else other, other))
        out += [(query, i, other, -s) for i, (s, _, other) in enumerate(sorted(scores, key=lambda r: r[:2])[:k], 1)]
    return sorted(out, key=repr)


def found_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_twenty(c):
    return c % 20 == 0


@pytest.mark.parametrize("cell_rows", [4096, 60])
def test_recall_of_neighbours(spark, cell_rows):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()])
    got = found_rows(projections.neighbours(table, by_twenty, cell_rows=cell_rows))
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.95 * len(want)


@pytest.mark.parametrize("cell_rows", [4096, 50])
def test_neighbours_of_unlike_norms_and_many_copies(spark, cell_rows):
    """Norms over six octaves, a vector with 300 copies, small integers with very many ties."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(12) * 2.0 ** rng.integers(-3, 3)).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0] * 12) for i in range(300)] + [(900 + i, rng.integers(0, 2, 12).astype(float).tolist()) for i in range(300)]
    rows = [r for r in rows if any(r[1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = brute_neighbours(rows)
    got = found_rows(projections.neighbours(table, by_twenty, cell_rows=cell_rows, sure=0.999))
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.98 * len(want)
    for q in {r[0] for r in got}:
        own = sorted(r for r in got if r[0] == q)
        assert [r[1] for r in own] == list(range(1, 21)) and [(-r[3], r[2]) for r in own] == sorted((-r[3], r[2]) for r in own)


def test_neighbours_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [2.0, 1.0]), (40, [1.0, 2.0]), (3, [-1.0]), (4, [5.0, 0.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (60, [0.0, 3.0])]
    bad = [(80, None), (100, []), (120, [0.0, -0.0]), (140, [1.0, None]), (160, [1.0, nan]), (180, [inf, 1.0])]
    table = spark.createDataFrame([(*r, "q", 1.0, 2) for r in good + bad], "vec_id long, embedding array<double>, q string, score double, v int")
    distinct = [(i, v + [0.0] * (3 - len(v))) for i, v in {(i, tuple(v)): (i, v) for i, v in good}.values()]
    assert found_rows(projections.neighbours(table, by_twenty)) == brute_neighbours(distinct)
    assert projections.neighbours(table.where("false"), by_twenty).collect() == []
    assert projections.neighbours(table.where("vec_id = 60"), by_twenty).collect() == []


def test_chi_square_quantiles():
    assert projections.quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert projections.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    with pytest.raises(ValueError):
        projections.quantile(0.95, 7)


# --- collocations


def brute_collocations(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for x in range(len(p)):
                for y in range(x + 2, len(p) + 1):
                    if y - x < len(p):
                        around[p[x:y]] = max(around[p[x:y]], a)
        found = []
        for p, a in candidates.items():
            if p not in around or 100 * around[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "top", "sample", "bits"), [(30, 2000, 8, 1 << 27), (4, 40, 3, 1 << 27), (5, 2000, 500, 1 << 27), (5, 2000, 4, 1 << 10)])
def test_collocations_match_brute_force(spark, small, least, top, sample, bits):
    """Production values; a cut among ties; a sample that misses nearly all, so that the border fails; filters that have nearly everything."""
    rows = [(r.text, r.lang) for r in small.select("text", "lang").collect()]
    assert phrase_rows(collocations.collocations(small, least, top, sample, bits)) == brute_collocations(rows, least, top)


def test_a_failing_border_is_closed(spark):
    """No document is in the sample: every phrase has to come from a failure of the border."""
    texts = ["one two three four five"] * 40 + ["two three"] * 10
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").withColumn("doc_id", F.lit(1))
    sample = next(k for k in range(2, 99) if not docs.where(F.pmod(F.xxhash64("text"), F.lit(k)) == 0).count())
    got = phrase_rows(collocations.collocations(docs, sample=sample))
    assert got == brute_collocations([(t, "en") for t in texts]) and any(len(r[2].split()) == 4 for r in got)


def test_collocations_of_awkward_rows(spark):
    rows = [(r[0], (r[1] or "") and r[1] * 3, *r[2:]) for r in odd_documents()] + [(1, None, "und", None, None, None, None), (2, "A\tb c.A b c\x1fd,A b c\x0ba b c! Ä b c" * 40, None, "", 1, 1, 1), (3, "no words " * 31, "", "", 1, 1, 1), (4, ".,;:!?\n\r\x0b\x0c", "fr", "", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    for least in (30, 4):
        want = brute_collocations([(r[1], r[2]) for r in rows], least)
        assert len({r[0] for r in want}) == (2 if least == 30 else 3)
        assert phrase_rows(collocations.collocations(docs, least)) == want
    assert collocations.collocations(docs.where("false")).collect() == []
