"""The whole pipeline against a chain of plain loops and dictionaries."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from skein.llm import bpe, decontaminate, kneser_ney, pseudonyms
from skein.llm.queries import PII_KEY
from tests.llm.test_text_operators import VOCABULARY, brute_models, brute_near, brute_nll

DATA = "/root/testdata/sf0.001"


def brute_quality(docs, labels, fold, quantile=0.995, slack=1.05):
    """The ids and texts that stay; docs are (doc_id, text, lang), fold has each id's."""
    said = defaultdict(list)
    for doc_id, quality, toxic in labels:
        said[doc_id].append((quality, toxic or 0))
    trusted = {i for i, x in said.items() if all(q == 1 and t == 0 for q, t in x)}
    models, memo = brute_models([(fold[i], t or "") for i, t, _ in docs if i in trusted]), [{}, {}]
    scored = [(i, lang or "und", len((t or "").encode()), brute_nll(t or "", models[fold[i]], memo[fold[i]])) for i, t, lang in docs]
    sums = defaultdict(lambda: [0.0, 0])
    for i, lang, n, x in scored:
        if i in trusted:
            for key in (lang, None):
                sums[key][0] += x
                sums[key][1] += n
    mean = lambda lang: (sums[lang] if sums.get(lang, [0, 0])[1] else sums[None])
    prior = kneser_ney.PRIOR_BYTES
    rate = [(x + prior * mean(lang)[0] / mean(lang)[1]) / (n + prior) for _, lang, n, x in scored]
    steps = defaultdict(list)
    for (i, lang, _, _), r in zip(scored, rate, strict=True):
        if i in trusted:
            steps[lang].append(math.ceil(r / kneser_ney.STEP))
            steps[None].append(steps[lang][-1])
    limit = {lang: sorted(s)[math.ceil(quantile * len(s)) - 1] * kneser_ney.STEP for lang, s in steps.items()}
    bad = {i for (i, lang, _, _), r in zip(scored, rate, strict=True) if math.exp(r) > slack * math.exp(limit.get(lang, limit[None]))}
    return [(i, t) for i, t, _ in docs if i not in bad]


def brute_template(text):
    """``(template word, value or None, itself, starts a sentence)`` of each word."""
    out, before, counted = [], None, False
    for m in re.finditer("[^\x20\x09-\x0d]+", text or ""):
        core = m.group().strip(decontaminate.PUNCTUATION)
        inner = before is not None and "\n" not in text[before.end() : m.start()] and not re.search(r"[.!?:]\W*$", before.group(), re.ASCII)
        before = m
        if not core:
            continue
        low = core.lower()
        if re.search(decontaminate.NUMBER, core) or low in decontaminate.NUMBER_WORDS:
            kind = "number"
        elif inner and regex.search(decontaminate.NAME, core):
            kind = "name"
        else:
            kind = "unit" if counted and low in decontaminate.UNITS else None
        out.append(((kind,), low, low, not inner) if kind else (low, None, low, not inner))
        counted = kind == "number"
    return out


def brute_key(own):
    """What a window meets: its template, or its words if fewer than half are literal."""
    literal = sum(v is None for _, v, _, _ in own)
    return ("template", *(w for w, _, _, _ in own)) if 2 * literal >= len(own) else ("words", *(x for _, _, x, _ in own))


def brute_meetings(docs, items, window=8, least=5, coverage=0.1):
    """``{(doc_id, item_id): (windows met, windows of the item, coverage)}``."""
    found, count = defaultdict(list), defaultdict(int)
    for item_id, text in items:
        words = brute_template(text)
        n = min(window, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            own = words[a : a + n]
            count[item_id] += 1
            found[brute_key(own)].append((item_id, a, [v for _, v, _, _ in own if v is not None]))
    sizes, out = {len(k) - 1 for k in found}, {}
    for doc_id, text in docs:
        words, met, places = brute_template(text), defaultdict(set), defaultdict(set)
        for n in sizes:
            for a in range(len(words) - n + 1):
                alone = n == len(words)
                sentence = n >= 3 and words[a][3] and (a + n == len(words) or words[a + n][3])
                if n < least and not alone and not sentence:
                    continue
                own = words[a : a + n]
                for item_id, at, said in found.get(brute_key(own), ()):
                    met[item_id, a - at].update(zip([v for _, v, _, _ in own if v is not None], said, strict=True))
                    places[item_id, a - at].add(at)
        every = defaultdict(set)
        for key, at in places.items():
            pairs = met[key]
            if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                every[key[0]] |= at
        for item_id, at in every.items():
            if (share := round(len(at) / count[item_id], 6)) >= coverage:
                out[doc_id, item_id] = len(at), count[item_id], share
    return out


def brute_leaks(docs, items):
    """Ids of documents with enough of an item."""
    return {d for d, _ in brute_meetings(docs, items)}


def brute_run(docs, labels, items, fold):
    left = brute_quality(docs, labels, fold)
    ids = {d for d, c in brute_near(left) if d == c}
    counts = [len(docs), len(left), len(ids)]
    left = [(d, t) for d, t in left if d in ids]
    bad = brute_leaks(left, items)
    left = [(d, t) for d, t in left if d not in bad]
    out = []
    for d, t in left:
        text = None if t is None else pseudonyms.rewrite(t, PII_KEY)[0]
        ids = bpe.encoding(VOCABULARY).encode_ordinary(text or "")
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out), [*counts, len(left)]


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark")]


def test_run_is_the_chain_of_plain_loops(spark, tables):
    docs, labels, bench = tables
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    want, counts = brute_run(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], {r.doc_id: r.fold for r in kneser_ney.with_fold(docs).collect()})
    assert sorted(tuple(r) for r in bpe.digests(corpus_pipeline.run(spark, DATA)).collect()) == want
    assert all(a > b for a, b in zip(counts, counts[1:])), counts  # each of the filtering stages has something to do


def test_stages_keep_the_columns(spark, tables):
    docs = tables[0]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), DATA).dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_decontamination_leaves_clean_documents(tables):
    docs, _, bench = tables
    rows, items = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]
    gone = {r[0] for r in rows} - {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert gone == brute_leaks(rows, items)


def test_meetings_are_those_of_plain_loops(spark, tables):
    """Items, windows and coverage of every meeting, on the given tables and on made-up questions."""
    docs, _, bench = tables
    made_docs, made_items = questions()
    for rows, items in (([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]), ([(i, t) for i, (t, _) in enumerate(made_docs)], made_items)):
        found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert found and {(r.doc_id, r.item_id): (r.n_windows, r.n_item_windows, r.coverage) for r in found} == brute_meetings(rows, items)


#: Words of the made-up questions.
FORMS = [
    "If {a} buys {x} apples for the school party and {b} brings {y} pears, how many fruits are on the table in the end?",
    "A train leaves the old station with {x} people on board and {y} get off at the bridge; how many are left?",
    "The farmer {a} has {x} cows that give {y} litres of milk each, so how much milk is there every morning?",
    "When {a} walks {x} km to the lake and {b} runs {y} km back home, who of them was faster that day?",
    "Each of the {x} shelves in the library of {a} holds {y} books; how many books does the library have in all?",
]
NAMES = ["Tom", "Ann", "Sam", "Lea", "Max", "Eva", "Ben", "Ida"]


def questions():
    """Documents with whether they leak, and items: re-parameterised questions in running text, and clean texts full of numbers."""
    import random

    rng = random.Random(12)
    number = lambda: rng.choice([str(rng.randrange(2, 900)), *decontaminate.NUMBER_WORDS[:9]])

    def filled(form):
        a, b = rng.sample(NAMES, 2)
        x, y = rng.sample(range(2, 900), 2)
        return form.format(a=a, b=b, x=x, y=y)

    def varied(form):
        a, b = rng.sample(NAMES, 2)
        x = number()
        return form.format(a=a, b=b, x=x, y=next(v for v in iter(number, None) if v != x))

    items = [(i, filled(f)) for i, f in enumerate(FORMS)] + [(50, "What is the next number of 2 4 8 16 32 64 128 256 512 in this row ?"), (51, "Is water wet?"), (52, "Yes.")]
    filler = lambda n: " ".join(rng.choice(["stone", "river", "under", "seldom", "green", "window", "carry", "often", "paper", "lamp"]) for _ in range(n))
    docs = [(f"{filler(30)}. {varied(rng.choice(FORMS))} {filler(20)}", True) for _ in range(60)]
    docs += [("we asked them: is water wet? and they said yes", True), ("Is water wet?", True), ("Yes.", True), (f"{filler(9)}: What is the next number of 3 6 12 24 48 96 192 384 768 in this row ?", True)]
    docs += [(f"Lottery of today: {' '.join(str(rng.randrange(1, 99)) for _ in range(9))} and good luck to everyone who plays", False) for _ in range(20)]
    docs += [(f"Table {i}: {' '.join(f'{rng.randrange(90)} kg' for _ in range(12))} {filler(10)}", False) for i in range(10)]
    docs += [(f"{filler(12)} and {rng.choice(NAMES)} has {number()} of them. Yes. {filler(12)} if {rng.choice(NAMES)} buys {number()} more {filler(8)}", False) for _ in range(20)]
    docs += [("they know that water is wet and so is the river", False), ("he wondered is water wet or not", False)]
    return docs, items


def test_reparameterised_questions_go_and_clean_numbers_stay(spark):
    docs, items = questions()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    gone = set(range(len(docs))) - kept
    leaks = {i for i, (_, leak) in enumerate(docs) if leak}
    assert len(gone & leaks) >= 0.9 * len(leaks) and not gone - leaks, (sorted(leaks - gone)[:5], [docs[i][0] for i in sorted(gone - leaks)[:5]])
