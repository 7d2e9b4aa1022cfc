"""Phrase collocations by stripes: every prefix keys a counter of its next words, and stripes merge element by element.

From the merged stripes come all extensions with their counts, the totals of prefixes (those of one word more are entries
of the stripe above; the words of a language are the total of the empty prefix, whose slot "" holds what is not told
apart) and the largest extension that may subsume a phrase. Most phrases are rare and need no counter of their own. So hashes of
phrases are counted first, length by length: those of one word more only where both parts may be frequent. What is
frequent by hash goes into a Bloom filter of bounded size; a false positive costs a counter, never a
result, since stripes hold the words themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _C1, SLICE_BYTES, forget, mix, saved, slice_hashes, small, text_slices

#: Bits of a filter: 16 a phrase, as a power of two up to this bound (8 MB).
MAX_BITS = 1 << 26
_PAGE = 4096
#: Hashes that a task gathers before it counts them and sends them on.
MAX_HASHES = 1 << 22
#: Parts in which hashes are counted: this many, and more so that one part stands for at most so many bytes of text.
HASH_PARTS, PART_BYTES = 512, 48 << 20
#: Pairs (prefix, next word) that a task counts before it sends them on.
MAX_PAIRS = 1_200_000
#: Parts of a stripe by the hash of the next word, by the words of the prefix: no stripe meets whole in one row.
SHARDS = (64, 8, 2, 1)
#: Parts of a language's candidates that are ranked apart first.
RANK_PARTS = 64

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)

_STRIPES = "k int, lang string, prefix string, shard int, nexts array<string>, counts array<long>"
_ARROW = pa.schema([("k", pa.int32()), ("lang", pa.string()), ("prefix", pa.string()), ("shard", pa.int32()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _bodies(texts: list[bytes]):
    """The texts with pieces ended by line feeds and words parted by one blank, in parts that end with a piece."""
    body = b"\n".join(texts).translate(_TABLE)
    while b"  " in body:
        body = body.replace(b"  ", b" ")
    at = 0
    while at < len(body):
        cut = body.find(b"\n", at + SLICE_BYTES) if len(body) - at > 2 * SLICE_BYTES else -1
        end = cut + 1 or len(body)
        yield body[at:end]
        at = end


def _words(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, piece and hash of every word."""
    raw = np.frombuffer(body + bytes(8), dtype=np.uint8)
    b = raw[: len(body)]
    edge = np.flatnonzero(np.diff((b == 32) | (b == 10), prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.cumsum(b == 10)[start], slice_hashes(raw, start, end - start)


def _grams(h: np.ndarray, k: int, lang: str) -> np.ndarray:
    """A hash of every k words in a row."""
    m = len(h) - k + 1
    g = mix(h[:m] + np.uint64(zlib.crc32(lang.encode()) << 32))
    for j in range(1, k):
        g = mix(g * _C1 + h[j : m + j])
    return g


def _keys(g: np.ndarray, parts: int) -> np.ndarray:
    """Hashes as the part in which they are counted and 32 bits."""
    return (g >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)


def _probes(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = mix(keys + _C1), np.uint64(n_bits - 1)
    return x & mask, (x >> np.uint64(32)) & mask


def _frequent(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for p in _probes(keys, len(bits) * 8):
        found &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _by_lang(batch: pa.RecordBatch):
    """(lang, body) of a batch's texts."""
    langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text")
    for lang in sorted(set(langs)):
        own = texts.take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
        for _, some in text_slices(range(len(own)), own):
            for body in _bodies(some):
                yield lang, body


# ---------------------------------------------------------------- which phrases may be frequent


def _hashes(k: int, shorter, parts: int, least: int):
    """Texts to hashes of phrases of k words with counts, by part; only those whose two parts of k - 1 words may be frequent."""
    small_count = np.min_scalar_type(least)

    def sent(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part, first = np.unique(keys >> np.uint64(32), return_index=True)
        low, counts = keys.astype(np.uint32), np.minimum(counts, least).astype(small_count)
        ends = [*first[1:], len(keys)]
        for s in range(0, len(part), 10_000):
            some = list(zip(first[s : s + 10_000], ends[s : s + 10_000]))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[s : s + 10_000].astype(np.int32)), "keys": pa.array([low[a:b].tobytes() for a, b in some], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lang, body in _by_lang(batch):
                _, _, piece, h = _words(body)
                m = len(h) - k + 1
                if m <= 0:
                    continue
                good = piece[:m] == piece[k - 1 :]
                if k > 1:
                    known = _frequent(shorter.value, _keys(_grams(h, k - 1, lang), parts))
                    good &= known[:m] & known[1:]
                held.append(_keys(_grams(h, k, lang)[good], parts))
                size += len(held[-1])
                if size > MAX_HASHES:
                    yield from sent(held)
                    held, size = [], 0
        if size:
            yield from sent(held)

    return run


def _counted(least: int):
    """The keys of at least `least` phrases, from rows of a part that come one after the other."""
    small_count = np.min_scalar_type(least)

    def done(part, held):
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in held])
        counts = np.concatenate([np.frombuffer(c, small_count) for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        found = keys[first[total >= least]].astype(np.int64) | part << 32
        return pa.RecordBatch.from_pydict({"key": pa.array(found, pa.int64())})

    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if p != part and held:
                    yield done(part, held)
                    held = []
                part = p
                held.append((k, c))
        if held:
            yield done(part, held)

    return run


def _bloom(keys: DataFrame, count: int) -> np.ndarray:
    """The filter of keys: pages of bits joined by OR, at most MAX_BITS in all."""
    n_bits = min(MAX_BITS, 1 << max(16, (16 * count - 1).bit_length()))
    page_bits = _PAGE * 8

    def bits_of(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            for p in _probes(batch.column("key").to_numpy().astype(np.uint64), n_bits):
                order = np.argsort(p)
                page, first = np.unique(p[order] // page_bits, return_index=True)
                for own, inside in zip(page.tolist(), np.split(p[order], first[1:])):
                    at = (inside % page_bits).astype(np.int64)
                    np.bitwise_or.at(pages.setdefault(own, np.zeros(_PAGE, np.uint8)), at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"page": pa.array(list(pages), pa.int32()), "bits": pa.array([b.tobytes() for b in pages.values()], pa.binary())})

    def union(key, pdf):
        import pandas as pd

        return pd.DataFrame({"page": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    pages = keys.mapInArrow(bits_of, "page int, bits binary").groupBy("page").applyInPandas(union, "page int, bits binary")
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    for page, bits in pages.collect():  # at most MAX_BITS
        out[page * _PAGE : page * _PAGE + _PAGE] = np.frombuffer(bits, np.uint8)
    return out


# ---------------------------------------------------------------- stripes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _stripes_of(counts: dict[tuple, Counter]):
    """A task's phrases as stripes, one row for every prefix and part; the last word is the next one of the others."""
    for (k, lang), pairs in counts.items():
        stripes: dict[tuple, tuple[list, list]] = {}
        for phrase, c in pairs.items():
            prefix, _, word = phrase.rpartition(b" ")
            row = stripes.setdefault((prefix, zlib.crc32(word) % SHARDS[min(k, len(SHARDS) - 1)]), ([], []))
            row[0].append(word.decode())
            row[1].append(c)
        rows = [(k, lang, prefix.decode(), shard, *row) for (prefix, shard), row in stripes.items()]
        for s in range(0, len(rows), 20_000):
            yield _batch(rows[s : s + 20_000])


def _map(filters, parts: int):
    """Texts to stripes of prefixes of 0, 1, .. words; filters: of phrases of 1, 2, .. words."""

    def run(batches):
        counts: dict[tuple, Counter] = {}
        for batch in batches:
            for lang, body in _by_lang(batch):
                start, end, piece, h = _words(body)
                for k, bits in enumerate(filters):
                    m = len(h) - k
                    if m <= 0:
                        break
                    at = np.flatnonzero((piece[:m] == piece[k:]) & _frequent(bits.value, _keys(_grams(h, k + 1, lang), parts)))
                    seen = counts.setdefault((k, lang), Counter())
                    seen.update([body[a:b] for a, b in zip(start[at].tolist(), end[at + k].tolist())])
                    if not k:
                        seen[b""] += m - len(at)
                if sum(map(len, counts.values())) > MAX_PAIRS:
                    yield from _stripes_of(counts)
                    counts.clear()
        yield from _stripes_of(counts)

    return run


def _merge(least: int):
    """Stripes of one key, which come one after the other, added element by element; what stays rare goes to the slot ""."""

    def done(key, stripe):
        rare = sum(c for w, c in stripe.items() if w and c < least) + stripe.pop("", 0)
        kept = {w: c for w, c in stripe.items() if c >= least} | ({"": rare} if rare else {})
        return (*key, list(kept), list(kept.values()))

    def run(batches):
        key, stripe, rows = None, {}, []
        for batch in batches:
            for *own, nexts, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key:
                        rows.append(done(key, stripe))
                    key, stripe = own, {}
                    if len(rows) >= 20_000:
                        yield _batch(rows)
                        rows = []
                for w, c in zip(nexts, counts):
                    stripe[w] = stripe.get(w, 0) + c
        if key:
            yield _batch([*rows, done(key, stripe)])

    return run


def stripes(docs: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """The merged stripes of prefixes of 0 to max_words - 1 words (column k), from docs of lang and text, as a saved table."""
    sc, filters = docs.sparkSession.sparkContext, []
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(HASH_PARTS, -(-size // PART_BYTES))
    for k in range(1, max_words + 1):
        counted = docs.mapInArrow(_hashes(k, filters[-1] if filters else None, parts, min_count), "part int, keys binary, counts binary")
        keys = saved(counted.repartition("part").sortWithinPartitions("part").mapInArrow(_counted(min_count), "key long"), f"frequent-{k}")
        count = keys.count()
        if count or not filters:
            filters.append(sc.broadcast(_bloom(keys, count)))
        forget(keys)
        if not count:
            break
    key = ["k", "lang", "prefix", "shard"]
    out = saved(docs.mapInArrow(_map(filters, parts), _STRIPES).repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge(min_count), _STRIPES), "stripes")
    for b in filters:
        b.destroy()
    return out


def extensions(stripe: DataFrame) -> DataFrame:
    """(lang, words, phrase, f) of the stripes' told-apart extensions."""
    each = stripe.select("k", "lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("x")).where("x.nexts <> ''")
    return each.select("lang", (F.col("k") + 1).alias("words"), F.when(F.col("k") == 0, F.col("x.nexts")).otherwise(F.concat_ws(" ", "prefix", "x.nexts")).alias("phrase"), F.col("x.counts").alias("f"))


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, subsumed_percent: int = 80, scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per lang its best phrases: lang, rank, phrase, a (occurrences), l and r (of the parts of its worst cut), n (words of lang), score.

    Texts are lower-cased in A-Z and split at .,;:!? and line ends into pieces, those at blanks and tabs into words; phrases
    of 2 to max_words words with a >= min_count are candidates. score = scale * a div (l + r) of the lowest-scoring cut, ties to the
    shortest first part. A candidate whose words lie inside a longer candidate of at least subsumed_percent of its count is dropped.
    Ranked by score, then a, both descending, then phrase by bytes; the first `top` of each lang.

    A null text is empty, a null lang is 'und' (as is a lang of that name); repeated rows count each; an empty table, or one without
    words, gives no rows; other columns are ignored. Texts of any length are counted piece by piece.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    merged = stripes(rows, max_words, min_count)
    n = saved(merged.where("k = 0").select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")), "lang-words")
    f = saved(extensions(merged), "frequent-phrases")
    forget(merged)
    known, phrases = f.select("lang", "phrase", "f"), f.where("words > 1")
    # an occurrence of a longer phrase is one of all phrases between, so one word more on either side tells of all longer ones
    w = F.split("phrase", " ")
    inside = phrases.where("words > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " "))).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = "cast({} as decimal(20, 0))"
    kept = phrases.join(longest, ["lang", "phrase"], "left").where(f"longer is null or 100 * {wide.format('longer')} < {subsumed_percent} * {wide.format('f')}")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), "_rest": F.array_join(F.slice(w, F.col("k") + 1, F.size(w)), " ")})
    known = small(known, F.length("phrase") + 160)  # as a hash table holds them
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"]).join(known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    score = F.expr(f"({scale} * {wide.format('a')}) div ({wide.format('l')} + {wide.format('r')})").alias("score")
    worst = cuts.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of parts of a lang first, so that no task ranks a lang's candidates alone
    best = worst.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n) if n.count() <= 100_000 else n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
