"""Language-model scores from a log-frequency Bloom filter of word n-grams.

The texts are written once as batches of bounded bytes. One pass over them gives, for every batch, its
distinct tokens, word pairs and word triples with their training counts. One shuffle by a part of the
hash sums them: a part turns its n-grams into a part of the filter, and answers each batch with the
exact counts of its tokens and the levels of its tokens, pairs and triples. An n-gram of count c is
filed under levels 1 .. level(c), four to a doubling; a reader probes level after level until one is missing. The
filter grows with its entries and never leaves its part; nothing is broadcast. A last shuffle brings
each batch and its answers together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, groups, mix, saved, text_slices

#: Bits of the filter for each entry, whatever their number: an absent n-gram seems present about 3 % of the time.
BITS_AN_ENTRY, PROBES = 8, 3
#: Bits of the hash that name a part, at least, and bytes of text a part: there are more parts for more text, so that a part's size is bounded.
LEAST_PART_BITS, TEXT_A_PART = 7, 16 << 20
#: Text of a batch, whose n-grams are asked for together, in bytes; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Orders of the n-grams, and the weight that each order above the first has over those below it where its context is known.
ORDERS, WEIGHT = 3, 0.5

END = np.uint64(0xE0E0E0E0E0E0E0E1)
START = np.uint64(0x5A5A5A5A5A5A5A5B)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every token in order: the lower-cased words of each text, then one end."""
    w = Words(texts)
    at = np.cumsum(w.count)
    return np.insert(w.doc, at, np.arange(len(texts))), np.insert(w.hash, at, END)


def ngrams(doc: np.ndarray, tok: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 to ORDERS that end at every token; START stands before a text's first."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out, before = [tok], tok
    for k in range(1, ORDERS):
        before = np.concatenate([[START], before[:-1]])
        before[first] = mix(np.full(1, START + np.uint64(k)))
        out.append(mix(mix(before + np.uint64(11 * k)) ^ tok))
        before = out[-1]
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def part_bits(text_bytes: int) -> int:
    """Bits of the part number for so much text."""
    return max(LEAST_PART_BITS, (text_bytes // TEXT_A_PART).bit_length())


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the keys of each part start in sorted hashes, and the end of the last."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the part's: with the part they name an n-gram of an order."""
    return (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpacked(rows, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), dtype=kind) for x in rows]


# ---------------------------------------------------------------- batches

BATCH = "task int, number int, n_bytes long, n_train long, ids binary, nulls binary, train binary, sizes binary, texts binary"


def _batches(batches):
    """Runs of rows as one row each: ids, marks and texts, at most BATCH_BYTES of text (or one text) a run."""
    task = TaskContext.get().partitionId()
    held: list[tuple] = []
    size = number = 0

    def closed():
        nonlocal number, size
        ids, train, texts = zip(*held)
        null = np.array([i is None for i in ids])
        row = (
            task, number, size, int(sum(train)), np.array([i or 0 for i in ids], dtype="<i8").tobytes(), np.packbits(null).tobytes(),
            np.packbits(np.array(train, dtype=bool)).tobytes(), np.array([len(t) for t in texts], dtype="<i8").tobytes(), zlib.compress(b"".join(texts), 1),
        )
        held.clear()
        number, size = number + 1, 0
        return pd.DataFrame([row], columns=[c.split()[0] for c in BATCH.split(", ")])

    for pdf in batches:
        for i, train, text in zip(pdf["_id"], pdf["train"], pdf["_text"]):
            b = text.encode()
            if held and size + len(b) > BATCH_BYTES:
                yield closed()
            held.append((None if pd.isna(i) else int(i), bool(train), b))
            size += len(b)
    if held:
        yield closed()


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(ids, nulls, train, texts) of a batch."""
    ids, sizes = np.frombuffer(row.ids, dtype="<i8"), np.frombuffer(row.sizes, dtype="<i8")
    bits = lambda x: np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(ids)).astype(bool)
    body, end = zlib.decompress(row.texts), np.cumsum(sizes)
    return ids, bits(row.nulls), bits(row.train), [body[e - n : e] for e, n in zip(end.tolist(), sizes.tolist())]


def _grams_of(texts: list[bytes], train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order, the sorted distinct n-grams of a batch and their counts in texts that train."""
    found: list[list] = [[] for _ in range(ORDERS)]
    for at, part in _slices(texts):
        doc, tok = tokens(part)
        for k, key in enumerate(ngrams(doc, tok)):
            found[k].append(summed(key, train[at][doc]))
    return [summed(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x])) for x in found]


def _slices(texts: list[bytes]):
    """(places, texts) of at most about SLICE_BYTES each."""
    for at, part in text_slices(range(len(texts)), texts):
        yield np.array(at), part


# ---------------------------------------------------------------- counts

ASKED = "part int, task int, number int, tokens binary, counts binary, " + ", ".join(f"keys{k} binary, times{k} binary" for k in range(2, ORDERS + 1))


def _counted(batches, bits: int):
    """Rows (part, batch, its distinct tokens and counts, the same of every higher order): one for each part that a batch has anything in."""
    names = [c.split()[0] for c in ASKED.split(", ")]
    for pdf in batches:
        for row in pdf.itertuples():
            _, _, train, texts = _opened(row)
            grams = _grams_of(texts, train)
            cuts = [_cuts(k, bits) for k, _ in grams]
            out = []
            for p in np.flatnonzero(np.any([np.diff(c) > 0 for c in cuts], axis=0)):
                cells = []
                for n, ((k, c), cut) in enumerate(zip(grams, cuts)):
                    own = slice(cut[p], cut[p + 1])
                    cells += [k[own].tobytes() if not n else _short(k[own], bits).astype("<u4").tobytes(), _packed(c[own], "<u4")]
                out.append((int(p), row.task, row.number, *cells))
            yield pd.DataFrame(out, columns=names)


#: Where levels begin: every count up to 8, then four to a doubling.
BOUNDS = np.unique(np.ceil(2 ** (np.arange(4 * 50) / 4))).astype(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, np.maximum(count, 1), side="right")


def least_count(lev: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for none."""
    return np.where(lev > 0, BOUNDS[np.maximum(lev, 1) - 1], 0).astype(float)


def most_count(lev: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 for none."""
    return BOUNDS[lev].astype(float) - 1


def _slots(key: np.ndarray, lev: np.ndarray, bits: np.ndarray | int) -> list[np.ndarray]:
    """The bits of entries (32-bit key, level) in a part of so many bits."""
    h = mix(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lev.astype(np.uint64))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    n = np.asarray(bits, dtype=np.uint64)
    return [((a + np.uint64(i) * b) % n).astype(np.int64) for i in range(PROBES)]


def filter_part(key: np.ndarray, count: np.ndarray, part_bits: int = LEAST_PART_BITS) -> np.ndarray:
    """A filter part as bytes; its size follows its entries alone, however many parts there are."""
    top = level(count)
    entries = int(top.sum())
    bits = max(64, -(-entries * BITS_AN_ENTRY // 64) * 64)
    on = np.zeros(bits, dtype=bool)
    for lev in range(1, int(top.max(initial=0)) + 1):
        for s in _slots(key[top >= lev], np.full(int((top >= lev).sum()), lev), bits):
            on[s] = True
    return np.packbits(on, bitorder="little")


class Filter:
    """Some of the parts side by side; the others are empty."""

    def __init__(self, parts: dict[int, bytes], part_bits: int = LEAST_PART_BITS):
        self.part_bits = part_bits
        size = np.full(1 << part_bits, 8, dtype=np.int64)
        size[list(parts)] = [len(x) for x in parts.values()]
        start = np.cumsum(size) - size
        self.at, self.bits = start * 8, size * 8
        self.blob = np.zeros(int(size.sum()), dtype=np.uint8)
        for p, x in parts.items():
            self.blob[start[p] : start[p] + len(x)] = np.frombuffer(x, dtype=np.uint8)

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """Level found for every n-gram hash, 0 for none: never below the true one."""
        return self.find((gram >> np.uint64(64 - self.part_bits)).astype(np.int64), _short(gram, self.part_bits))

    def find(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """levels for n-grams given as their part and the 32 bits after it."""
        out = np.zeros(len(key), dtype=np.int64)
        todo, lev = np.arange(len(key)), 1
        while len(todo):
            p, hit = part[todo], np.ones(len(todo), dtype=bool)
            for s in _slots(key[todo], np.full(len(todo), lev), self.bits[p]):
                s = s + self.at[p]
                hit &= (self.blob[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            todo = todo[hit]
            out[todo] = lev
            lev += 1
        return out


ANSWERS = "task int, number int, part int, counts binary, " + ", ".join(f"levels{k} binary" for k in range(1, ORDERS + 1)) + ", n long, v long, mass double"


def _merged(batches, bits: int):
    """Per part: answers to its batches (token counts, and the level of each n-gram asked for, in the order asked), then its sums (task -1: N, V, and the mass of its known words as levels tell it)."""
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    for (part,), pdf in groups(batches, ["part"]):
        part = int(part)
        asked = [[np.frombuffer(k, dtype="<u8") for k in pdf["tokens"]], *([np.frombuffer(x, dtype="<u4") for x in pdf[f"keys{k}"]] for k in range(2, ORDERS + 1))]
        times = [_unpacked(pdf[c], "<u4") for c in ("counts", *(f"times{k}" for k in range(2, ORDERS + 1)))]
        sums = [summed(np.concatenate(k), np.concatenate(c)) for k, c in zip(asked, times)]
        levels = []
        for n, (k, c) in enumerate(sums):
            key = _short(k, bits) if not n else k
            levels.append(Filter({part: filter_part(key[c > 0], c[c > 0], bits).tobytes()}, bits).find(np.full(len(key), part), key))
        rows = []
        for i, (t, number) in enumerate(zip(pdf["task"].tolist(), pdf["number"].tolist())):
            at = [np.searchsorted(k, x[i]) for (k, _), x in zip(sums, asked)]
            rows.append((t, number, part, _packed(sums[0][1][at[0]], "<u8"), *(_packed(lev[x], "u1") for lev, x in zip(levels, at)), 0, 0, 0.0))
        c = sums[0][1]
        rows.append((-1, 0, part, b"", *[b""] * ORDERS, int(c.sum()), int((c > 0).sum()), float(least_count(levels[0][c > 0]).sum())))
        yield pd.DataFrame(rows, columns=names)


# ---------------------------------------------------------------- scores

SCORED = "_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def probabilities(levels: list[np.ndarray], starts: np.ndarray, n_train: int, total: float) -> np.ndarray:
    """Probability of every token from the levels of the n-grams of orders 1 to ORDERS that end at it.

    Words are smoothed by one and divided by total: the mass of all known words as their levels tell it, their number, and one. Each
    higher order mixes its relative frequency, with WEIGHT, into the estimate of the order below where its context was seen: the least
    count of its level over the largest of its context's. So the shares of all words after a context sum to at most 1, whatever
    the levels hide; only false positives of the filter can add to that. starts marks a text's first token.
    """
    p, before = (least_count(levels[0]) + 1) / total, levels[0]
    begun = starts.copy()
    for k in range(1, ORDERS):
        context = most_count(np.concatenate([[0], before[:-1]]))
        # before a text's first token stands the start alone, which has no context of a higher order
        context[begun] = n_train if k == 1 else 0.0
        before = np.minimum(levels[k], levels[k - 1])  # true levels never rise with the order
        share = np.minimum(least_count(before), context)
        p = np.where(context > 0, (1 - WEIGHT) * p + WEIGHT * share / np.maximum(context, 1), p)
    return p


def _scored(n_all: int, v_all: int, mass: float, n_train: int):
    def run(batches):
        for _, pdf in groups(batches, ["task", "number"]):
            told = pdf[pdf["part"] >= 0]
            (batch,) = pdf[pdf["part"] < 0].itertuples()
            ids, nulls, train, texts = _opened(batch)
            known = [k for k, _ in _grams_of(texts, np.zeros(len(texts), dtype=bool))]
            count = np.concatenate(_unpacked(told["counts"], "<u8")).astype(np.int64)
            values = [np.concatenate(_unpacked(told[f"levels{k}"], "u1")).astype(np.int64) for k in range(1, ORDERS + 1)]
            out = []
            for at, part in _slices(texts):
                doc, tok = tokens(part)
                place = [np.searchsorted(k, x) for k, x in zip(known, ngrams(doc, tok))]
                c = count[place[0]]
                base = (c + 1) / (n_all + v_all + 1)
                p = probabilities([v[x] for v, x in zip(values, place)], np.diff(doc, prepend=-1) > 0, n_train, mass + v_all + 1)
                m = len(part)
                add = lambda x: np.bincount(doc, weights=x, minlength=m)
                ident = pd.array(ids[at], dtype="Int64")
                ident[nulls[at]] = pd.NA
                out.append(pd.DataFrame({"_id": ident, "train": train[at], "n_tokens": np.bincount(doc, minlength=m), "n_known": add(c > 0).astype(np.int64), "base_score": add(np.log10(base)), "score": add(np.log10(p))}))
            yield pd.concat(out)

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, trained (the value of the column train), n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end. base_score sums
    log10((c + 1) / (N + V + 1)) with the exact training counts; score is the sum of log10 probabilities
    by words, pairs and triples, whose counts all come from the filter (see probabilities). Null and
    empty texts are the end alone; without any training row all counts are 0. Null train counts as
    false. Repeated rows stay, and count each where they train; rows of null id too; an empty table
    gives no rows; other columns are ignored. docs is read once: rows may come in any order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("train"))
    batches = saved(rows.mapInPandas(_batches, BATCH), "lm-batches")
    size, n_train, tasks = batches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.max("task"), F.lit(0)) + 1).first()
    bits, spread = part_bits(size), int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = batches.mapInPandas(lambda it: _counted(it, bits), ASKED)
    # parts, and then batches, are dealt out in turn: tasks get equally many
    merged = counted.repartitionById(spread, F.pmod("part", F.lit(spread))).sortWithinPartitions("part").mapInPandas(lambda it: _merged(it, bits), ANSWERS)
    merged = saved(merged, "lm-answers")
    n_all, v_all, mass = merged.where("task = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "mass")]).first()
    both = batches.withColumn("part", F.lit(-1)).unionByName(merged.where("task >= 0").drop("n", "v", "mass"), allowMissingColumns=True)
    turn = F.pmod(F.col("task").cast("long") + F.col("number").cast("long") * tasks, F.lit(spread)).cast("int")
    done = both.repartitionById(spread, turn).sortWithinPartitions("task", "number", "part").mapInPandas(_scored(int(n_all), int(v_all), float(mass), int(n_train)), SCORED)
    return done.select(F.col("_id").alias(id_col), F.col("train").alias("trained"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
