"""Lexical search, decontamination and collocations against plain loops, on nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import collocations, decontamination, lexical_search

DOCS = "doc_id long, text string, lang string, row long, _id string, phrase string, item string, words int, f long"
ITEMS = "item_id long, text string, terms string, t int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentence(r, n):
    return " ".join(r.choice(["the", "of", "And", "re", "éle", "x1", "a's", "zu", "big", "red"]) + r.choice([" ", "  ", ", ", ".", "\t", "\n"])[: r.choice([0, 0, 1])] for _ in range(n))


def texts():
    r = random.Random(3)
    base = [sentence(r, n) for n in (1, 2, 5, 9, 10, 40, 200, 1500)]
    items = ITEM_TEXTS[:6]
    return [None, "", " \n;", *base, base[5], base[5], base[6] + " " + items[0], items[1].upper() + "!" + base[4], "x " + items[2], "a a a a a a a a a a a a", "\x00<|end|> \U0001f600é \U0001f600é", base[7] * 40 + items[3] + base[6], "ab cd"]


_r = random.Random(8)
ITEM_TEXTS = [" ".join(_r.choice(["ka", "lo", "mi", "ne", "the", "of", "red"]) for _ in range(n)) for n in (24, 11, 10, 30, 4, 1)] + ["a a a a a a a a a a a", "", None, "ab, cd"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], 1, "clash", "p", "i", 1, 2) for i, t in enumerate(texts())]
    again = [(5, texts()[5], "en", 2, None, None, None, None, None), (5, texts()[9], "en", 2, None, None, None, None, None), (None, texts()[10], "und", 2, None, None, None, None, None), (None, texts()[10], "und", 2, None, None, None, None, None)]
    return spark.createDataFrame(rows + again, DOCS).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k, t, "clash", 3) for k, t in enumerate(ITEM_TEXTS)] + [(2, ITEM_TEXTS[0], None, None), (None, ITEM_TEXTS[1], None, None)], ITEMS)


# ---- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def ranked(docs, items, top):
    held = [(r.doc_id, terms(r.text)) for r in docs]
    held = [(i, t, collections.Counter(t)) for i, t in held if t]
    N, L = len(held), sum(len(t) for _, t, _ in held)
    df = collections.Counter(x for _, _, c in held for x in c)
    asks = collections.defaultdict(set)
    for r in items:
        asks[r.item_id] |= set(terms(r.text))
    out = []
    for item, wanted in asks.items():
        scores = []
        for i, t, c in held:
            m = 50 + 50 * len(t) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 20 * m)) for x in wanted if x in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_search(docs, items):
    for top, block in ((3, 1 << 22), (50, 10_000)):  # one block, and several
        got = lexical_search.search(docs, items, top, block_bytes=block).collect()
        assert sorted(map(tuple, got), key=str) == ranked(docs.collect(), items.collect(), top)


class Held:
    """What a broadcast gives a worker."""

    def __init__(self, value):
        self.value = value


def test_search_keeps_few(monkeypatch):
    """A task that may hold few candidates keeps the same best, ties by id."""
    monkeypatch.setattr(lexical_search, "MAX_HELD", 1)
    monkeypatch.setattr(lexical_search, "CELLS", 6)
    r = random.Random(1)
    data = [(r.choice([k, None]), " ".join(r.choice("ab c") for _ in range(r.randint(0, 6)))) for k in range(60)]
    batches = [pa.RecordBatch.from_pydict({"_id": pa.array([i for i, _ in data[s : s + 7]], pa.int64()), "text": [t for _, t in data[s : s + 7]]}) for s in range(0, 60, 7)]
    block = Held({"key": "few", "terms": ["a", "b"], "at": np.array([0, 2, 3]), "of": np.array([0, 1, 1]), "items": 2})
    got = [r for b in lexical_search._best(block, Held(np.array([3, 5])), 50, 150, 2)(batches) for r in zip(*(c.to_pylist() for c in b.columns))]

    def gain(k, t):
        n, c = len(t.split()), t.split().count("ab"[k])
        return [3, 5][k] * (1_000_000_000 * c // (1000 * c + 20 * (50 + 50 * n * 50 // 150)))

    for item, of in ((0, [0]), (1, [0, 1])):
        scores = sorted(((-sum(gain(k, t) for k in of), i is None, i or 0) for i, t in data))
        best = [(item, -s, None if none else i) for s, none, i in scores if s][:2]
        assert sorted(x for x in got if x[0] == item) == sorted(best) or [x[1] for x in got if x[0] == item] == [x[1] for x in best]


def test_search_of_nothing(spark, docs, items):
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        got = lexical_search.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_guarded_automaton():
    a = lexical_search.automaton(["ab", "b", "éa"])
    (n, tf), = lexical_search._scan(a, ["AB b abb, b-éA b".encode()])
    assert n == 6 and tf == {0: 1, 1: 3, 2: 1}


# ---- decontamination


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def judged(docs, items, run=10):
    windows = collections.defaultdict(set)
    for r in items:
        w = plain(r.text)
        t = min(run, len(w))
        for s in range(len(w) - t + 1 if t else 0):
            windows[tuple(w[s : s + t])].add(str(r.item_id) if r.item_id is not None else "")
    out = []
    for r in docs:
        w, hit, found = plain(r.text), set(), set()
        for t in {len(x) for x in windows}:
            for s in range(len(w) - t + 1):
                if tuple(w[s : s + t]) in windows:
                    hit |= set(range(s, s + t))
                    found |= windows[tuple(w[s : s + t])]
        out.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run,gram", [(10, 3), (4, 2)])
def test_contaminated(docs, items, run, gram):
    got = decontamination.contaminated(docs, items, run, gram).collect()
    assert sorted(map(tuple, got), key=str) == judged(docs.collect(), items.collect(), run)
    assert sum(r.contaminated for r in got) >= 5


def test_no_items(docs, items):
    got = decontamination.contaminated(docs, items.where("text is null")).collect()
    assert sorted(map(tuple, got), key=str) == judged(docs.collect(), [])
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


def test_every_shared_run_is_found(spark):
    """The guarantee of winnowing: any run of ten words in common has a kept gram in common."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = []
    for k in range(200):
        shared = [r.choice("abc") for _ in range(10)]
        rows.append((k, [r.choice("abcd") for _ in range(r.randint(0, 12))] + shared + [r.choice("abcd") for _ in range(r.randint(0, 12))], [r.choice("abcd") for _ in range(r.randint(0, 12))] + shared))
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    prints = lambda c: F.transform(decontamination.winnowed(F.col(c), 10, 3), decontamination.fingerprint)
    assert df.where(~F.arrays_overlap(prints("a"), prints("b"))).count() == 0


def test_native(docs, items):
    plan = decontamination.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- collocations


def counted(docs, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in docs:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top", [(3, 4, 2000), (2, 3, 7)])
def test_collocations(docs, least, longest, top):
    got = sorted(map(tuple, collocations.collocations(docs, least, longest, top).collect()))
    assert got == counted(docs.collect(), least, longest, top)
    assert len(got) > 3


def test_collocations_in_many_parts(monkeypatch):
    """Hashes and stripes that are sent on early and cut into parts give the same counts."""
    for name, value in (("MAX_PAIRS", 5), ("SLICE_BYTES", 40), ("MAX_HASHES", 7)):
        monkeypatch.setattr(collocations, name, value)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "und"] * 9, "text": (texts() * 2)[:18]})
    rows = lambda batches: sorted(((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))), key=lambda r: r[:4])

    def one(run, batches, of):
        return run([pa.RecordBatch.from_pydict({k: [r[j] for r in batches] for j, k in enumerate(of)})])

    filters = []
    for k in (1, 2):
        sent = rows(collocations._hashes(k, filters[-1] if filters else None, 3, 3)([batch]))
        keys = np.array([r[0] for r in rows(one(collocations._counted(3), sent, ["part", "keys", "counts"]))]).astype(np.uint64)
        bits = np.zeros(1 << 13, np.uint8)
        for p in collocations._probes(keys, 1 << 16):
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(int), np.left_shift(1, (p & np.uint64(7)).astype(int)).astype(np.uint8))
        filters.append(Held(bits))
    told = rows(b for r in [rows(collocations._map(filters, 3)([batch]))] for b in one(collocations._merge(3), r, ["k", "lang", "prefix", "shard", "nexts", "counts"]))
    found, n = {}, collections.Counter()
    for k, lang, prefix, _, nexts, counts in told:
        found |= {(lang, f"{prefix} {w}".strip()): c for w, c in zip(nexts, counts) if w}
        n[lang] += sum(counts) * (k == 0)
    f, words = collections.Counter(), collections.Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            f.update((lang, " ".join(w[i : i + k])) for k in (1, 2) for i in range(len(w) - k + 1))
    assert found == {p: c for p, c in f.items() if c >= 3} and n == words


def test_no_collocations(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text is null"), 1).count() == 0


def test_wide_scores(spark):
    """Products beyond 64 bits stay exact."""
    rows = [("a b " * 50, "en")]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 30, 2, scale=10**18).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("a b", 50, 50, 50, 10**18 * 50 // 100), ("b a", 49, 50, 50, 10**18 * 49 // 100)]
