"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import ann, bpe, chat, exact_dedup, jaccard_join, lm_score, packing, quality, suffix_dedup, url_filter
from rankweave.llm.queries import vocabulary

DOCS = "doc_id long, text string, _id string, rank int, key string"


def words(r, n):
    return " ".join(r.choice(["the", "of", "And", "tion", "re", "éle", "x1", "a's", "zu"]) + r.choice(["", "", "n", "m,"]) for _ in range(n))


def texts():
    r = random.Random(5)
    base = [words(r, n) for n in (1, 2, 3, 12, 40, 120, 400)]
    near = [base[5] + " extra", base[5].replace("the", "teh", 1), base[6].replace("of", "off", 2)]
    return [None, "", "   \n", *base, *near, base[4], base[4], base[6], "a " * 3000, "\x00<|end|>\\ \U0001f600 é", "same", "same", words(r, 900) + base[6] + words(r, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, "k") for i, t in enumerate(texts())] + [(4, texts()[4], "again", 2, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]


# ---- 9


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    data = rows_of(docs)
    by = collections.defaultdict(list)
    for i, b in data:
        by[hashlib.sha256(b).hexdigest()].append(i)
    assert len(got) == len(data)
    for r in got:
        assert (r.keep_id, r.group_size) == (max(by[r.text_sha256]), len(by[r.text_sha256])) and r.doc_id in by[r.text_sha256]
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(by)


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_fingerprints", _colliding)
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True)}


def _colliding(batches):
    import pandas as pd

    for pdf in batches:
        yield pd.DataFrame({"_id": pdf["_id"], "n_bytes": 2, "fp": 7, "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in pdf["_text"]], "_text": pdf["_text"]})


def test_an_id_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_COPY", 2)
    rows = [(4, "A"), (4, "B"), (9, "A"), (4, "A"), (None, "A"), (None, "B"), (None, None), (3, ""), (7, "z"), (7, "z")] + [(20 + i, "hot") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    got = exact_dedup.exact_groups(df).collect()
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    assert collections.Counter((r.doc_id, digest[r.text_sha256]) for r in got) == collections.Counter((i, t or "") for i, t in rows)
    for r in got:
        ids = by[digest[r.text_sha256]]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(digest[r.text_sha256] for r in got if r.kept) == sorted(by)
    assert sorted(r.text or "" for r in exact_dedup.drop_copies(df).collect()) == sorted(by)


def test_fingerprints_combine():
    r = random.Random(1)
    for _ in range(20):
        a, b = r.randbytes(r.randint(0, 40_000)), r.randbytes(r.randint(0, 40_000))
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(a + b)


# ---- 10 and 6


def reference_encoder(name):
    import public_tokenizers
    import tiktoken

    ranks = bpe.tiktoken_ranks(open(vocabulary(name), "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(docs, none):
    enc = reference_encoder("byte_bpe_multi_50k.tiktoken")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    data = collections.Counter()
    for i, b in rows_of(docs):
        ids = np.array(enc.encode_ordinary(b.decode()), dtype="<u4")
        data[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b).hexdigest()] += 1
    got = bpe.bpe_round_trip(docs, path, with_ids=True).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == data
    assert all((r.ends[-1] if r.ends else 0) == len(dict(rows_of(docs))[r.doc_id]) for r in got)
    assert bpe.bpe_round_trip(none, path).count() == 0


def test_bpe_on_odd_texts():
    enc = reference_encoder("byte_bpe_multi_50k.tiktoken")
    own = bpe.Encoder(bpe.tiktoken_ranks(open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb").read()))
    r = random.Random(3)
    odd = ["".join(r.choice(" \n\t's're'll vé²1x!?\u3000\u00a0\u0301\U0001f600dtm") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    odd += ["a" * 3000, "!" * 3000, " " * 999 + "x", "'s's'll", "\n'd "]
    for t, ids in zip(odd, own.encode([t.encode() for t in odd])):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_the_scan_is_a_walk():
    """States by the scan equal those of a walk, symbol by symbol, whatever the symbols; composition is associative."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        symbol = rng.integers(0, bpe.ALONE + 1, rng.integers(1, 40)) if _ % 2 else rng.choice([bpe.QUOTE1, bpe.QUOTE2, bpe.WORD, bpe.SIGN], rng.integers(1, 40))
        state, walked = bpe.NONE, []
        for x in symbol:
            state = bpe.STEP[x, state]
            walked.append(state)
        assert bpe.states(symbol.astype(np.uint8)).tolist() == walked
    f = rng.integers(0, 11, (64, 11)).astype(np.uint8)
    want = f.copy()
    for i in range(1, len(f)):
        want[i] = f[i][want[i - 1]]
    got = bpe.scan(f)
    assert (got[:, 0] == want[:, 0]).all()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    data = collections.Counter(rows_of(docs))
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), limit=128, max_segments=4, max_loss=120, with_ids=True).toPandas()
    seq = got.groupby("sequence_id")
    assert seq.length.sum().max() <= 128 and seq.size().max() <= 4
    ends = got.start + got.length == got.doc_tokens
    assert (got.length - ends).groupby(got.sequence_id).sum().max() <= 120
    s = got.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    for (i, b), copies in data.items():
        ids = np.array([*tok.encode(b.decode(), add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got.doc_id == i]
        assert mine.length.sum() == copies * len(ids) and set(mine.doc_tokens) == {len(ids)}
        for r in mine.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and list(r.ids) == part.tolist()
    assert packing.pack_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_dot_product_fills_on_all_limits():
    tokens, loss = np.array([60, 40, 50, 50, 30]), np.array([10, 90, 50, 50, 0])
    done, left = packing.place(tokens, loss, (100, 2, 100), True, cut=False)
    assert not left and sorted(i for s in done for i, _, _ in s) == [0, 1, 2, 3, 4]
    for s in done:
        assert sum(n for _, _, n in s) <= 100 and len(s) <= 2 and sum(loss[i] for i, _, _ in s) <= 100
    assert len(done) == 3


# ---- 3


def brute_repeats(data, length):
    seen = collections.Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    out = []
    for t in data:
        cov = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cov[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, cov) if not y)
        out.append((len(t), sum(cov), sum(cov[i] and not (i and cov[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,block", [(48, 512), (48, 3), (200, 512)])
def test_repeats(docs, none, length, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", block)
    data = rows_of(docs)
    want = collections.Counter((i, *x) for (i, _), x in zip(data, brute_repeats([b for _, b in data], length)))
    assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, length).collect()) == want
    assert suffix_dedup.remove_repeats(none, length).count() == 0
    assert suffix_dedup.without_repeats(docs, length).columns == docs.columns


def test_covers():
    """Longest shared stretches on both sides against all pairs."""
    r = random.Random(12)
    for trial in range(300):
        m, length = r.randint(2, 14), r.choice([6, 10, 16])
        cut = lambda: bytes(r.choice(b"ab") for _ in range(r.randint(0, 12)))
        base = [cut() for _ in range(3)]
        before = [r.choice(base)[: r.randint(0, 12)] + cut()[: r.randint(0, 3)] for _ in range(m)]
        after = [r.choice(base)[: r.randint(0, 12)] + cut()[: r.randint(0, 3)] for _ in range(m)]
        want = []
        for i in range(m):
            found = [(suffix_dedup.common_prefix(before[i], before[j]), suffix_dedup.common_prefix(after[i], after[j])) for j in range(m) if j != i]
            fine = [x for x in found if sum(x) >= length]
            want.append((max((x for x, _ in fine), default=0), max((y for _, y in fine), default=0)))
        got = suffix_dedup.covers(before, after, length)
        assert list(zip(got[0].tolist(), got[1].tolist())) == want


def test_deep_shallow_sort():
    r = random.Random(2)
    for _ in range(200):
        base = bytes(r.choice(b"ab") for _ in range(90))
        s = [base[: r.randint(0, 90)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 30))]
        assert [s[i] for i in suffix_dedup.deep_shallow_sort(s, 0, 8)] == sorted(s)


# ---- 4


def brute_links(data, k, num, den):
    sets = {}
    for i, b in data:
        w = b.lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,num,block", [(3, 90, 256), (5, 80, 256), (1, 60, 2)])
def test_near_duplicates(spark, docs, none, k, num, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    r = random.Random(9)
    more = [(100 + i, " ".join(w if r.random() > 0.01 else w + "q" for w in texts()[9].split()), "", 0, "") for i in range(25)]
    df = docs.unionByName(spark.createDataFrame(more, DOCS))
    want = brute_links(rows_of(df), k, num, 100)
    got = jaccard_join.near_duplicates(df, k, num).collect()
    assert len(got) == df.count()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert jaccard_join.near_duplicates(none, k, num).count() == 0
    assert {x.doc_id for x in jaccard_join.drop_near_duplicates(df, k, num).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_large_clusters_move_texts_to_partners_only(spark, monkeypatch):
    """Of a chain of texts, each near the next alone, a block's texts do not go to every other block; the chain is one component, each long copy of its own one too."""
    r, seen, f = random.Random(2), [], jaccard_join.by_group
    text, chain = [str(r.random()) for _ in range(90)], []
    for k in range(300):
        chain.append((k, " ".join(text)))
        text[k * 7 % 90] = f"w{k}"
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "by_group", lambda df, *a: seen.append(df) or f(df, *a))
    got = jaccard_join.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 5, 80).collect()
    assert {x.component_id for x in got} == {0} and len(got) == 300
    texts = [df.count() for df in seen if "_text" in df.columns]
    assert len(texts) == 1 and texts[0] < 300 * 2 * 19 / 3  # two size classes, some 19 blocks


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for trial in range(400):
        n, num = int(rng.integers(5, 300)), (80, 90)[trial % 2]
        a = set(rng.integers(0, 2**63, n, dtype=np.uint64).tolist())
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.pop()
            else:
                c.add(int(rng.integers(0, 2**63)))
            if 100 * len(a & c) < num * len(a | c):
                break
            b = c
        if a != b:
            sa, sb = (np.array(sorted(x), dtype=np.uint64) for x in (a, b))
            d, k = jaccard_join.band_keys(np.array([0] * len(sa) + [1] * len(sb)), np.concatenate([sa, sb]), 2, num, 100)
            assert set(k[d == 0].tolist()) & set(k[d == 1].tolist())


@pytest.mark.parametrize("num", [40, 50, 60, 70, 80])
def test_linked_sets_of_two_slices_share_a_key(num):
    """The smaller set is alone in its slice: it must still send keys for the bands of all larger sets it reaches."""
    rng = np.random.default_rng(6)
    for n in range(20, 400, 7):
        b = np.unique(rng.integers(0, 2**63, n * 100 // num, dtype=np.uint64))
        a = np.sort(rng.permutation(b)[:n])
        (_, ka), (_, kb) = (jaccard_join.band_keys(np.zeros(len(x), dtype=np.int64), x, 1, num, 100) for x in (a, b))
        assert set(ka.tolist()) & set(kb.tolist())


# ---- 8


def test_lm_counts(docs, none):
    train = F.col("doc_id") % 3 != 1
    data = rows_of(docs)
    count = collections.Counter(w for i, b in data if i % 3 != 1 for w in [*b.lower().split(), None])
    n, v = sum(count.values()), len(count)
    got = lm_score.score_texts(docs, train).toPandas()
    assert len(got) == len(data)
    by_id = dict(data)
    for r in got.itertuples():
        t = [*by_id[r.doc_id].lower().split(), None]
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(t), sum(count[w] > 0 for w in t), n, r.doc_id % 3 != 1)
        assert abs(r.base_score - base) < 1e-6 and np.isfinite(r.score) and r.score < 0
    seen = got[got.trained & (got.n_tokens > 20)]
    assert (seen.score > seen.base_score).all()
    assert lm_score.score_texts(none, train).count() == 0


def test_lm_mass():
    """Over all words the probabilities after any context sum to at most 1, and to 1 after one that was never seen."""
    r = random.Random(4)
    vocabulary = [chr(97 + k) for k in range(20)]
    texts = [[r.choice(vocabulary[: r.choice([2, 5, 20])]) for _ in range(r.randint(1, 60))] + [None] for _ in range(80)]
    count = [collections.Counter(("^", *t)[i : i + k] if k > 1 else (w,) for t in texts for i, w in enumerate((t if k == 1 else ["^", *t])) if len(("^", *t)[i : i + k]) == k or k == 1) for k in (1, 2, 3)]
    v = len(count[0])
    mass = sum(float(lm_score.least_count(lm_score.level(np.array([c])))[0]) for c in count[0].values())
    lev = lambda k, g: int(lm_score.level(np.array([count[k - 1][g]]))[0]) if count[k - 1][g] else 0

    def total(before):
        """before: the two tokens before, the first of which may be the start."""
        out = 0
        for w, times in [(x, 1) for (x,) in count[0]] + [("never", 1)]:
            g = [*before, w]
            # the levels at the three places, the last of which is asked for
            levels = [np.array([lev(1, (x,)) if x != "^" else 0 for x in g]), np.array([0, lev(2, tuple(g[:2])), lev(2, tuple(g[1:]))]), np.array([0, 0, lev(3, tuple(g))])]
            out += times * lm_score.probabilities(levels, np.array([True, False, False]), len(texts), mass + v + 1)[2]
        return out

    sums = [total(b) for b in list(count[1])[:60] if None not in b and "^" not in b]
    assert len(sums) >= 10 and max(sums) <= 1.001 and min(sums) > 0.85
    assert abs(total(("never", "again")) - 1) < 1e-9


@pytest.mark.parametrize("bits", [7, 10])
def test_filter_never_below(bits):
    rng = np.random.default_rng(0)
    pair = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    count = rng.integers(1, 200, 5000)
    part = (pair >> np.uint64(64 - bits)).astype(int)
    key = lm_score._short(pair, bits)
    f = lm_score.Filter({p: lm_score.filter_part(key[part == p], count[part == p], bits).tobytes() for p in set(part.tolist())}, bits)
    assert (f.levels(pair) >= lm_score.level(count)).all()
    assert (f.levels(rng.integers(0, 2**64, 5000, dtype=np.uint64)) > 0).mean() < 0.1


def test_filter_grows_with_its_entries():
    """A small share of a large filter stays as sharp as the whole: few absent pairs seem present."""
    rng = np.random.default_rng(1)
    bits = 20
    part = np.uint64(5) << np.uint64(64 - bits)
    pair = part | rng.integers(0, 2**44, 40_000, dtype=np.uint64)
    count = rng.integers(1, 200, len(pair))
    made = lm_score.filter_part(lm_score._short(pair, bits), count, bits)
    assert len(made) >= lm_score.level(count).sum()  # before anything is probed: a full filter has no level that is missing
    f = lm_score.Filter({5: made.tobytes()}, bits)
    assert (f.levels(pair) >= lm_score.level(count)).all()
    assert (f.levels(part | rng.integers(0, 2**44, 40_000, dtype=np.uint64)) > 0).mean() < 0.05


def brute_scores(of, train):
    """Log10 probabilities by counts at their true levels: what the filter may only raise."""
    grams = [collections.Counter() for _ in range(3)]
    for i in train:
        t = [0, *of[i]]
        for k in range(3):
            grams[k].update(tuple(t[max(0, j - k) : j + 1]) for j in range(1, len(t)) if k < 2 or j > 1)
    # a count is known up to a quarter of a doubling
    bounds = sorted({math.ceil(2 ** (k / 4)) for k in range(80)})
    least = lambda g: float(max((b for b in bounds if b <= grams[len(g) - 1][g]), default=0))
    most = lambda g: min(b for b in bounds if b > grams[len(g) - 1][g]) - 1.0
    total = sum(map(least, grams[0])) + len(grams[0]) + 1
    out = {}
    for i, words_of in of.items():
        t = [0, *words_of]
        sum_ = 0.0
        for j in range(1, len(t)):
            p = (least((t[j],)) + 1) / total
            context = len(train) if j == 1 else most((t[j - 1],))
            if context:
                p = 0.5 * p + 0.5 * min(least((t[j - 1], t[j])), context) / context
            if j > 1 and (context := most((t[j - 2], t[j - 1]))):
                p = 0.5 * p + 0.5 * least((t[j - 2], t[j - 1], t[j])) / context
            sum_ += np.log10(p)
        out[i] = sum_
    return out


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 100_000)
    r = random.Random(9)
    rows = [(i, words(r, r.choice([1, 5, 30, 90]))) for i in range(3000)]
    of = {i: [w.lower() for w in t.split()] + [None] for i, t in rows}
    want = brute_scores(of, [i for i in of if i % 5])
    # rows in no fixed order: two readings of this table differ
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = lm_score.score_texts(df, F.col("doc_id") % 5 != 0).toPandas()
    assert sorted(got.doc_id) == sorted(of)
    over = np.array([x.score - want[x.doc_id] for x in got.itertuples()])
    # a level that seems one higher raises a count or a context: few of them, and little
    assert abs(over).sum() < 0.05 * sum(map(len, of.values()))
    # words follow one another at random here: contexts tell nothing, and probabilities that sum to 1 cannot beat the exact words by much, nor lose much
    assert (abs(got.score - got.base_score) / got.n_tokens)[got.n_tokens > 20].mean() < 0.1


def test_lm_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 5000)
    long = "word " * 3000
    df = spark.createDataFrame([(1, long), (None, "a b"), (2, None), (3, "a b"), (3, "a b")], "doc_id long, text string").repartition(1)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.train_tokens, round(r.score, 6)) for r in lm_score.score_texts(df, F.col("doc_id") == 3).collect())
    assert [x[:3] for x in got] == [((False, 0), 3, 6), ((True, 1), 3001, 6), ((True, 2), 1, 6), ((True, 3), 3, 6), ((True, 3), 3, 6)]
    assert got[0][3] == got[3][3] == got[4][3]


# ---- 5


def test_quality(spark, none):
    r = random.Random(0)
    rows = [(i, words(r, 30) if i % 3 else " ".join(w + "%%%" for w in words(r, 30).split()), "", 0, "") for i in range(240)]
    rows += [(900, None, "", 0, ""), (901, "", "", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5000, 1), (None, 0), (7, None)], "doc_id long, quality int")
    model = quality.fit(df, labels.where("doc_id % 4 <> 0 or doc_id is null"))
    got = quality.score(df, model).toPandas()
    assert list(got.columns) == [*df.columns, "score", "predicted"] and got.score.between(0, 1).all()
    held = got[(got.doc_id < 240) & ((got.doc_id % 4 == 0) | (got.doc_id >= 200))]
    assert (held.predicted == (held.doc_id % 3 > 0)).mean() >= 0.95
    assert quality.score(none, model).count() == 0
    assert quality.score(df, quality.fit(df, labels.limit(0))).toPandas().score.notna().all()


def test_quality_features():
    """Pooled vectors and counts of a text, word by word."""
    rng = np.random.default_rng(3)
    table = lambda n: rng.normal(size=(n, quality.DIMS)).astype(np.float32)
    model = quality.Model(table(quality.WORD_BUCKETS), table(quality.SHAPE_BUCKETS))
    some = ["The the CAT sat2 on on on", "", "éle x1 %% x1", "One", " \n "]
    assert np.array_equal(model.features([b""]), model.features([b"", b"a b"])[:1])
    for t, x in zip(some, model.features([t.encode() for t in some])):
        each = [quality.streams([w.encode()]) for w in t.split()]
        n, low = max(1, len(each)), [w.lower() for w in t.split()]
        for k, (vectors, place) in enumerate(((model.words, 1), (model.shapes, 2))):
            mean = np.mean([vectors[e[place][0]] for e in each], axis=0) if each else np.zeros(quality.DIMS)
            assert np.allclose(x[k * quality.DIMS : (k + 1) * quality.DIMS], mean, atol=1e-5)
            assert np.isclose(x[2 * quality.DIMS + k], np.sqrt(max(0, 1 - (mean**2).sum())), atol=1e-4)
        assert np.allclose(x[2 * quality.DIMS + 2 :], [len(set(low)) / np.sqrt(n), np.log1p(len(low)), sum(a == b for a, b in zip(low, low[1:])) / n], atol=1e-5)


# ---- 2


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))).tolist()
    rows = [(i, v, "clash") for i, v in enumerate(x)] + [(i, x[3], "same") for i in range(900, 1200)]
    rows += [(2000, None, ""), (2001, [0.0] * 16, ""), (2002, [float("nan")] * 16, ""), (2003, [1.0, 2.0], ""), (None, x[0], ""), (5, x[5], "again"), (2004, [None, *x[0][1:]], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    ids = np.array([r[0] for r in rows[:1200]])
    v = np.array([r[1] for r in rows[:1200]])
    norm = np.sqrt((v**2).sum(axis=1))
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = (v * v[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((ids, -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.array_equal(mine.score, s[mine.vec_id])
        hit += len(set(want) & set(mine.vec_id))
        total += 5
    assert hit / total >= 0.9
    assert set(got.query_id) == set(ids[ids % 50 == 0].tolist())
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_nearest_of_extremes(spark):
    """Squares of finite components may leave the range of doubles; cosines do not."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [3.0, 1.0]), (3, [1e-200, 1e-200]), (4, [-5e-324, 0.0]), (5, [1.7e308, -1.7e308])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    want = [(3, 1.0), (2, 4 / 20**0.5), (1, 0.5**0.5), (5, 0.0), (4, -(0.5**0.5))]
    assert [r.vec_id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want], abs=1e-15)


# ---- 7


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.b", "", "block"), ("", "/all", "block"), ("x.y", "/q.z", "allow"), ("x.y", "/q.z", "block"), ("net", "/a+(b", "block")], "host string, path string, verdict string")
    urls = ["http://www.example.org/es/1", "http://EXAMPLE.org/en", "https://norg/x", None, "nothing", "http://a.b", "http://z.a.b/all", "q://any/allowed", "http://x.y/q.zz?a", "http://x.y/qaz", "http://example.org", "http://n.net/a+(bc", "http://example.org/es/1#f", "", "a://b://c.org/d"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(1, urls[1], "again"), (None, urls[0], "")], "page_id long, url string, host string")
    got = url_filter.judge_urls(df, rules).collect()
    want = ["example.org/es/", "org/", None, None, None, "a.b", "/all", "/all", "x.y/q.z", None, None, "net/a+(b", "example.org/es/", None, None]
    assert len(got) == len(urls) + 2
    for r in got:
        rule = want[r.page_id] if r.page_id is not None else want[0]
        assert r.rule == rule, r
        assert r.verdict == {"org/": "allow", None: "allow"}.get(rule, "block"), r
    assert {(r.host, r.path) for r in got if r.page_id in (3, 4, 13)} == {("", "")}
    assert {(r.host, r.path) for r in got if r.page_id == 1} == {("example.org", "/en")}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert url_filter.judge_urls(df, rules.limit(0)).where("verdict = 'allow'").count() == len(urls) + 2


def test_urls_with_blanks(spark):
    """A host may hold any character but '/', '?' and '#'; what parts host and path must not be one of them."""
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.b", "", "block"), ("b#c", "/", "block"), ("q", "/x#y", "block"), ("w.v", "/a b", "block")], "host string, path string, verdict string")
    urls = {"http://a b.org/x": "org/", "http://a b.example.org/es/1": "example.org/es/", "http://a.b c.com/x": None, "http://x a.b/": None, "http://x .a.b/": "a.b", "http://b#c/": None, "http://q/x#y": None, "http://w.v/a bc": "w.v/a b", "http://w.v/a": None, "x://a\n.org/\n": "org/"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {u: r.rule for r in url_filter.judge_urls(df, rules).collect() for u in [list(urls)[r.page_id]]} == urls


# ---- 1


def test_chats(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<", "|>", None, "", "\U0001f600é", "<|im_turn|><|im_start|>user<|im_sep|>", "[\\INST]", "x\ny"]
    rows = [(1, i, ["user", "assistant", "assistant", None, "<|r|>", "system"][i % 6], t, "clash") for i, t in enumerate(tricky)]
    rows += [(2, 0, "assistant", "hi", ""), (2, 0, "assistant", "hi", ""), (None, 1, "user", "a", ""), (3, None, "assistant", None, "")]
    # turns that tie come in the order of their texts as given, not as escaped
    rows += [(4, 0, "user", "<|b", ""), (4, 0, "user", "<a", ""), (4, 0, "<|r", "x", ""), (4, 0, "<a", "x", "")]
    rows += [(5, i, ["assistant", "user"][i % 3 % 2], f"t{i}", "") for i in range(2 * chat.RUN + 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = chat.format_chats(df)
    got = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = collections.defaultdict(list)
    for c, i, role, text, _ in rows:
        by[c].append((i is not None, i or 0, role or "", text or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        want = [(x[2], x[3]) for x in sorted(by[r.conv_id])]
        assert [tuple(x) for x in r.t] == want
        assert r.loss == [t for role, t in want if role == "assistant"]
    one = next(r.formatted for r in got if r.conv_id == 2)
    assert one == "<|im_start|>assistant<|im_sep|>hi<|im_turn|>hi<|im_end|>"
    assert chat.format_chats(df.limit(0)).count() == 0
