"""N-gram Jaccard join by parity sketches.

A text's shingles are dealt by hash into m bands; inside a band each shingle flips one of 2**40 bits.
Flipping cancels in pairs, so the bands in which two sketches differ, like their Hamming distance,
are at most the symmetric difference of the sets. Two sets of sizes a, b reach similarity t only if
that is at most T = (1 - t)(a + b)/(1 + t); of m bands at least m - T agree. Texts meet on a band's
parity word (as its 64-bit signature), within bands of set size. Of two sets' words at least m - T are
common, so the first T + 1 of each in a fixed order hold such a one: the best filled come first.
Shingles that many texts hold flip no bit, which keeps unlike texts apart. Texts that meet form candidate clusters, inside which a
dense sketch's Hamming distance and then the sets themselves decide. Between the blocks of a large cluster short sketches move first,
and of the texts only those that one of the other block may link with.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, block_pairs, by_group, components, groups, mix, saved, shingles, small, text_slices

#: Sizes of sets grow by this factor from one size band to the next.
BAND_RATIO = 1.35
#: Texts of a candidate cluster that one side of a task's block holds.
BLOCK_ROWS = 1024
#: Texts whose shingles tell the common ones (at most a fourth of their shingles, a few MB), and in how many of them those are.
SAMPLE_TEXTS, COMMON_IN = 4096, 4
#: Keys that a task gathers before it deals them out, and shingles of the corpus a part.
KEYS_HELD, KEYS_A_PART = 1_500_000, 2_000_000

_BIT = np.uint64((1 << 40) - 1)


def size_bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, up to beyond most."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
    return np.array([*ends, max(ends[-1] + 1, int(ends[-1] * BAND_RATIO))])


def band_keys(doc: np.ndarray, sh: np.ndarray, n_docs: int, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) rows of the distinct shingles sh of texts doc (sorted by text); common: sorted shingles that flip no bit.

    Leaving the same shingles out of all sketches can only lower their differences, so nothing is missed.
    """
    n = np.bincount(doc, minlength=n_docs)
    out_d, out_k = [], []
    if not len(sh):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, sh), len(common) - 1)] != sh
        doc, sh = doc[rare], sh[rare]
    # up to the largest set that one of these can reach, which may be in another slice
    ends = size_bands(int(n.max()) * den // num)
    own = np.searchsorted(ends, n, side="right") - 1
    # a set that no different set can reach needs no key
    reach = (den - num) * (n + n * den // num) // (den + num) >= 1
    step = 0
    while True:
        g = np.minimum(own + step, len(ends) - 2)
        use = reach & (n > 0) & (own + step < len(ends) - 1) & ((step == 0) | (n * den >= num * ends[g]))
        if not use.any():
            break
        most = (den - num) * 2 * (ends[g + 1] - 1) // (den + num)
        m = most + 2 + most // 2
        base = np.cumsum(np.where(use, m, 0)) - np.where(use, m, 0)
        on = use[doc]
        d, h = doc[on], sh[on]
        band = (mix(h) % m[d].astype(np.uint64)).astype(np.int64)
        slot = base[d] + band
        total = int(np.where(use, m, 0).sum())
        word = np.zeros(total, dtype=np.uint64)
        np.bitwise_xor.at(word, slot, mix((mix(h + np.uint64(77)) & _BIT) + np.uint64(1)))
        filled = np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(n_docs), np.where(use, m, 0))
        place = np.arange(total) - base[owner]
        key = mix(word + mix((g[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)))
        # at least m - T bands agree, so of each set the first T + 1 in any common order do: the best filled
        order = np.lexsort((key, -np.minimum(filled, 3), owner))
        nth = np.arange(total) - base[owner]
        take = order[nth <= most[owner]]
        out_d.append(owner[take])
        out_k.append(key[take])
        step += 1
    if not out_d:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    d, k = np.concatenate(out_d), np.concatenate(out_k)
    order = np.argsort(d, kind="stable")
    return d[order], k[order]


def _sets(words: int):
    """Per text: size and 128-bit hash of its set."""

    def run(batches):
        for pdf in batches:
            for at, texts in text_slices(pdf["_id"], pdf["_text"]):
                doc, sh = shingles(Words(texts), len(texts), words)
                n = np.bincount(doc, minlength=len(texts))
                first = np.cumsum(n) - n
                a, b = mix(sh + np.uint64(5)), mix(sh + np.uint64(9))
                ca, cb = np.concatenate([[np.uint64(0)], np.cumsum(a)]), np.concatenate([[np.uint64(0)], np.cumsum(b)])
                out = pd.DataFrame({"_id": at, "n": n, "ha": (ca[first + n] - ca[first]).astype(np.int64), "hb": (cb[first + n] - cb[first]).astype(np.int64)})
                out["_id"] = out["_id"].astype("Int64")
                yield out

    return run


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of 64-bit integers, byte by byte and compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:size]).tobytes(), 1)


def _unplaned(data: bytes, size: int) -> np.ndarray:
    got = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size, -1)
    out = np.zeros((got.shape[1], 8), dtype=np.uint8)
    out[:, :size] = got.T
    return out.view("<u8").ravel()


def stars(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest id of every key, as (key, id), and the distinct (id, smallest id) links of all others."""
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    least = ident[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else ident
    other = ident != least
    return key[new], ident[new], np.unique(np.stack([ident[other], least[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), dtype=np.int64)


def common_shingles(rows: DataFrame, words: int, n_rows: int) -> np.ndarray:
    """Sorted hashes of shingles that at least COMMON_IN of about SAMPLE_TEXTS texts hold.

    What is common decides only how many candidates there are, never which links are found, so a
    bounded sample (by hash of the id) does.
    """
    some = rows.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, n_rows // SAMPLE_TEXTS))) == 0)

    def run(batches):
        for pdf in batches:
            for _, texts in text_slices(pdf["_id"], pdf["_text"]):
                h, c = np.unique(shingles(Words(texts), len(texts), words)[1], return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "c": c.astype(np.int32)})

    got = some.mapInPandas(run, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON_IN).select("h").collect()
    return np.sort(np.array([r[0] for r in got], dtype=np.int64).astype(np.uint64))


def _band_rows(words: int, num: int, den: int, bits: int, common):
    """Rows (part, keys, ids, links): keys of a run of texts dealt to 2**bits parts, each key once; texts that met already as links."""
    part_shift = np.uint64(64 - bits)

    def rows(keys, ids):
        k, i, links = stars(np.concatenate(keys), np.concatenate(ids))
        part = (k >> part_shift).astype(np.int64) if bits else np.zeros(len(k), dtype=np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for s, e in zip(cut, [*cut[1:], len(k)]):
            # the part and 40 more bits name a key: a mix-up only adds a candidate
            yield (int(part[s]), _planes((k[s:e] << np.uint64(bits)) >> np.uint64(24), 5), _planes(i[s:e], 8), b"")
        if len(links):
            yield (int(links[0, 0]) % (1 << bits), b"", b"", links.astype("<i8").tobytes())

    def run(batches):
        keys, ids, held = [], [], 0
        names = ["part", "keys", "ids", "links"]
        for pdf in batches:
            for at, texts in text_slices(pdf["_id"], pdf["_text"]):
                doc, sh = shingles(Words(texts), len(texts), words)
                d, k = band_keys(doc, sh, len(texts), num, den, common.value)
                keys.append(k)
                ids.append(np.array(at, dtype=np.int64)[d])
                held += len(k)
                if held >= KEYS_HELD:
                    yield pd.DataFrame(list(rows(keys, ids)), columns=names)
                    keys, ids, held = [], [], 0
        if held:
            yield pd.DataFrame(list(rows(keys, ids)), columns=names)

    return run


def _met(batches):
    """Links of the texts of a part that share a key."""
    for _, pdf in groups(batches, ["part"]):
        out = [np.frombuffer(x, dtype="<i8").reshape(-1, 2) for x in pdf["links"] if x]
        keyed = [(_unplaned(k, 5), _unplaned(i, 8).astype(np.int64)) for k, i in zip(pdf["keys"], pdf["ids"]) if k]
        if keyed:
            out.append(stars(np.concatenate([k for k, _ in keyed]), np.concatenate([i for _, i in keyed]))[2])
        links = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def spanning_links(ids, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the texts whose sets reach similarity num/den, by sketch distance and then exactly.

    Texts that are in one tree already are not compared again.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    words = max(1, 1 << int(np.ceil(np.log2(max(1, n.max() / 8)))))
    sketch = np.zeros((m, words), dtype=np.uint64)
    for i, s in enumerate(sets):
        bit = mix(s + np.uint64(3))
        np.bitwise_xor.at(sketch[i], ((bit >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    tree, out = np.arange(m), []
    for i in range(m - 1):
        rest = i + 1 + np.flatnonzero(tree[i + 1 :] != tree[i])
        a, b = n[i], n[rest]
        rest = rest[np.minimum(a, b) * den >= np.maximum(a, b) * num]
        most = (den - num) * (a + n[rest]) // (den + num)
        for j in rest[np.bitwise_count(sketch[i] ^ sketch[rest]).sum(axis=1, dtype=np.int64) <= most]:
            if tree[i] == tree[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (n[i] + n[j] - both):
                tree[tree == tree[j]] = tree[i]
                out.append((ids[i], ids[j]))
    return out


def _links(words: int, num: int, den: int):
    def run(batches):
        for _, pdf in groups(batches, ["cluster", "size", "_bi", "_bj"]):
            sets = []
            for _, texts in text_slices(pdf["_id"], pdf["_text"]):
                doc, sh = shingles(Words(texts), len(texts), words)
                sets += np.split(sh, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
            yield pd.DataFrame(spanning_links(pdf["_id"].tolist(), sets, num, den), columns=["a", "b"], dtype="int64")

    return run


def _short_sketches(words: int, num: int, den: int):
    """Rows (cluster, size, _id, n, sketch): a parity sketch of a text's set, as long as its size class asks so that unlike sets differ by more than linked ones can."""

    def run(batches):
        for pdf in batches:
            for at, texts in text_slices(range(len(pdf)), pdf["_text"]):
                doc, sh = shingles(Words(texts), len(texts), words)
                sets, out = np.split(sh, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]), []
                for k, s in zip(at, sets):
                    size = int(pdf["size"].iat[k])
                    bits = 64 * (1 + int(BAND_RATIO ** (size + 1) * 7 * (den - num) / (den + num)) // 64)
                    bit, sketch = mix(s + np.uint64(3)) % np.uint64(bits), np.zeros(bits // 64, dtype="<u8")
                    np.bitwise_xor.at(sketch, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                    out.append((pdf["cluster"].iat[k], size, pdf["_id"].iat[k], len(s), sketch.tobytes()))
                yield pd.DataFrame(out, columns=["cluster", "size", "_id", "n", "sketch"])

    return run


def _may_link(num: int, den: int):
    """Of the texts of two blocks, those that one of the other block may link with, by size and sketch: no other can."""
    names = ["cluster", "size", "_bi", "_bj", "_id"]

    def run(batches):
        for _, pdf in groups(batches, names[:4]):
            one = (pdf["_b"] == pdf["_bi"]).to_numpy()
            n, ids = pdf["n"].to_numpy(), pdf["_id"].to_numpy()
            sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype="<u8").reshape(len(pdf), -1)
            a, b, near = np.flatnonzero(one), np.flatnonzero(~one), np.zeros(len(pdf), dtype=bool)
            for i in a:
                like = b[np.minimum(n[i], n[b]) * den >= np.maximum(n[i], n[b]) * num]
                like = like[np.bitwise_count(sketch[i] ^ sketch[like]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[i] + n[like]) // (den + num)]
                near[like] = True
                near[i] |= len(like) > 0
            out = pdf.loc[near, names].drop_duplicates()
            yield out.astype({"cluster": "int64", "size": "int64", "_bi": "int32", "_bj": "int32", "_id": "int64"})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles (size of its set), component_id (smallest id reachable by links).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds the distinct runs of that many words,
    or the whole text's words if fewer; two texts link if den * intersection >= num * union. Null, empty
    and wordless texts have no set and no link: their component is their own id. Equal sets link.
    Repeated rows stay and link; where one id has several texts, any of them may link it. Rows of null id
    have the component of their set's other ids. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    feats = saved(rows.mapInPandas(_sets(words), "_id long, n long, ha long, hb long"), "shingle-sets")
    same = ["n", "ha", "hb"]
    reps = saved(feats.where("n > 0").groupBy(*same).agg(F.min("_id").alias("rep")), "equal-sets")
    # one text of each set takes part
    alone = feats.select("_id").distinct().join(reps.select(F.col("rep").alias("_id")), "_id", "left_anti")
    once = rows.where(F.col("_id").isNotNull()).join(small(saved(alone, "not-alone")), "_id", "left_anti")
    # texts that share a parity word meet at the smallest id of the word: each run of texts sends a word once
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, int(total // KEYS_A_PART).bit_length())
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(once, words, reps.count()))
    dealt = once.mapInPandas(_band_rows(words, num, den, bits, common), "part int, keys binary, ids binary, links binary")
    met = by_group(dealt, ["part"], _met, "a long, b long").distinct()
    cluster = components(saved(met, "met"), "candidate-clusters").withColumnRenamed("component", "cluster")
    # within a cluster only sets of like size can link: each joins its size class and those above that it can reach
    n = F.col("n").cast("double")
    classes = F.sequence(F.floor(F.log(BAND_RATIO, n)), F.floor(F.log(BAND_RATIO, n * den / num) + 1e-9))
    sized = reps.select(F.col("rep").alias("_id"), "n").join(small(cluster.withColumnRenamed("id", "_id")), "_id")
    sized = saved(sized.select("_id", "cluster", F.explode(classes).alias("size")).distinct(), "sized")
    paired = saved(block_pairs(sized, ["cluster", "size"], "_id", BLOCK_ROWS, own=True), "paired")
    across = paired.where("_bi <> _bj")
    if not across.isEmpty():
        # texts move once; to the other blocks go short sketches, and then the texts that these do not tell apart
        some = saved(across.select("_id", "cluster", "size").distinct(), "in-blocks")
        sketches = rows.join(small(some), "_id").mapInPandas(_short_sketches(words, num, den), "cluster long, size long, _id long, n long, sketch binary")
        placed = saved(sketches, "short-sketches").join(small(across), ["cluster", "size", "_id"])
        near = by_group(placed, ["cluster", "size", "_bi", "_bj"], _may_link(num, den), "cluster long, size long, _bi int, _bj int, _id long")
        paired = saved(paired.where("_bi = _bj").drop("_b").unionByName(near), "paired-texts")
    else:
        paired = paired.drop("_b")
    texts = rows.join(small(paired), "_id")
    links = by_group(texts, ["cluster", "size", "_bi", "_bj"], _links(words, num, den), "a long, b long")
    linked = components(saved(links, "links"), "linked")
    of_rep = reps.join(small(linked.withColumnRenamed("id", "rep")), "rep", "left").select(*same, F.coalesce("component", "rep").alias("_component"))
    out = feats.select("_id", *same).join(of_rep, same, "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_component", "_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the document of smallest id of each component of near_duplicates."""
    told = near_duplicates(docs, words, num, den, id_col, text_col)
    gone = saved(told.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "near-copies")
    return docs.join(small(gone), id_col, "left_anti").select(docs.columns)
