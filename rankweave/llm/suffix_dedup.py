"""Removal of long repeated byte strings, by a sparse suffix array sorted deep and shallow.

Any string of `length` bytes holds an anchor: the position of the smallest hash of a 16-byte gram in
it. Equal strings hold their anchors at equal places, so two equal strings are found from two anchors
with a shared stretch to the left and to the right of at least `length` bytes together, and at least
half of it on one side. Of an anchor's surroundings only the windows count that it is the anchor of:
in a run that repeats with a short period, anchors are dense but their surroundings few and equal. Anchors that share half a length on a side meet in a group; there the
stretches to the right and (read backwards) to the left are sorted as suffixes: multikey quicksort to
a shallow depth, then blind tries for the groups that are still equal. The common prefixes of
neighbours give the longest valid stretch on each side, which is what is covered.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_pairs, by_group, groups, mix, saved, small, words64

LENGTH = 400
GRAM = 16
#: Bytes that multikey quicksort looks at beyond what a group is known to share; blind tries go on from there.
SHALLOW = 32
#: Anchors of a group that one side of a task's block holds.
BLOCK_ROWS = 4096
#: Bytes whose anchors are sought at once.
SLICE = 1 << 20


# ---------------------------------------------------------------- suffix sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie_sort(rows: list[int], s: list[bytes], depth: int) -> list[int]:
    """rows sorted by s, all of which share their first depth bytes.

    A node is [branch depth, {byte: child}], a leaf a list of equal strings; -1 stands for the end of a
    string. A string goes down blindly by the branching bytes alone, is compared once with any string
    below, and is inserted where they part.
    """
    at = lambda t, d: t[d] if d < len(t) else -1
    root: list | None = None
    for r in rows:
        t = s[r]
        if root is None:
            root = ["leaf", [r]]
            continue
        node = root
        while node[0] != "leaf":
            kids = node[1]
            node = kids.get(at(t, node[0])) or next(iter(kids.values()))
        other = s[node[1][0]]
        split = depth + common_prefix(t[depth:], other[depth:])
        if split >= len(t) and split >= len(other):
            node[1].append(r)
            continue
        parent, node = None, root
        while node[0] != "leaf" and node[0] < split:
            parent, node = node, node[1][at(t, node[0])]
        if node[0] == split:
            node[1][at(t, split)] = ["leaf", [r]]
            continue
        new = [split, {at(other, split): node, at(t, split): ["leaf", [r]]}]
        if parent is None:
            root = new
        else:
            parent[1][at(t, parent[0])] = new
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(s: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The order of the strings s, which share their first depth bytes.

    Multikey quicksort on eight bytes at a time down to depth + shallow; groups that are still equal
    there, or have ended, go to blind tries.
    """
    out: list[int] = []
    stack = [(list(range(len(s))), depth)]
    while stack:
        rows, d = stack.pop()
        if len(rows) <= 1:
            out += rows
            continue
        if d >= depth + shallow:
            out += blind_trie_sort(rows, s, d)
            continue
        key = [s[r][d : d + 8] for r in rows]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        less = [r for r, k in zip(rows, key) if k < pivot]
        equal = [r for r, k in zip(rows, key) if k == pivot]
        more = [r for r, k in zip(rows, key) if k > pivot]
        stack.append((more, d))
        stack.append((equal, d + 8 if len(pivot) == 8 else depth + shallow))
        stack.append((less, d))
    return out


def neighbour_prefixes(s: list[bytes], order: list[int]) -> list[int]:
    """Common prefixes of neighbours in sorted order."""
    return [common_prefix(s[a], s[b]) for a, b in zip(order, order[1:])]


class RangeMinimum:
    """Smallest of any stretch of a list, by a table of stretches of doubling length."""

    def __init__(self, values: list[int]):
        self.rows = [np.array(values, dtype=np.int64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))
        self.rows = [r.tolist() for r in self.rows]

    def __call__(self, start: int, end: int) -> int:
        k = (end - start).bit_length() - 1
        row = self.rows[k]
        return min(row[start], row[end - (1 << k)])


def covers(before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, the longest stretches before and after it that lie in a string of length bytes shared with another.

    before is read backwards. Zeros where no string of length bytes is shared. The stretches after are
    sorted; sets of anchors grow together in descending order of their common prefix, the smaller into
    the larger, each kept in the order of its stretches before. An anchor that joins is compared with
    its two neighbours there only: a farther one shares less before and no more after than a nearer one.
    """
    m = len(after)
    left, right = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    if m == 2:
        r, b = common_prefix(*after), common_prefix(*before)
        return (np.full(2, b), np.full(2, r)) if r + b >= length else (left, right)
    order = deep_shallow_sort(after)
    depth = neighbour_prefixes(after, order)
    back = deep_shallow_sort(before)
    shared = RangeMinimum(neighbour_prefixes(before, back))
    place = [0] * m
    for k, i in enumerate(back):
        place[i] = k
    best_left, best_right = [0] * m, [0] * m
    root, sets = list(range(m)), {k: [place[i]] for k, i in enumerate(order)}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in sorted(range(m - 1), key=lambda k: -depth[k]):
        d = depth[k]
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        root[b] = a
        large, few = sets[a], sets.pop(b)
        for x in few:
            at = bisect.bisect_left(large, x)
            for y in large[max(0, at - 1) : at + 1]:
                lo, hi = (x, y) if x < y else (y, x)
                s = shared(lo, hi)
                if s + d >= length:
                    for i in (back[x], back[y]):
                        best_left[i], best_right[i] = max(best_left[i], s), max(best_right[i], d)
        large += few
        large.sort()
    return np.array(best_left), np.array(best_right)


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leftmost smallest 16-byte gram of every window of length bytes: its place, and the first and last window that it is that of."""
    n = len(data) - GRAM + 1
    w = length - GRAM + 1
    if len(data) < length:
        return (np.zeros(0, dtype=np.int64),) * 3
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = words64(padded)
    h = mix(eight[:n] + mix(eight[8 : n + 8] + np.uint64(1)))
    bits = np.uint64(max(24, int(n).bit_length()))
    v = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    full = -(-n // w) * w
    v = np.concatenate([v, np.full(full - n, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    k = len(data) - length + 1
    best = np.minimum(behind[:k], ahead[w - 1 : w - 1 + k]) & ((np.uint64(1) << bits) - np.uint64(1))
    first = np.flatnonzero(np.diff(best, prepend=np.uint64(full + 1)))
    return best[first].astype(np.int64), first, np.append(first[1:], k) - 1


def _int64(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _anchor_rows(length: int):
    half = length // 2

    def of_slice(keys, texts):
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        place, first, last = anchors(np.frombuffer(joined, dtype=np.uint8), length)
        sizes = np.array([len(t) for t in texts])
        starts = ends - sizes
        doc = np.minimum(np.searchsorted(ends, place, side="right"), len(texts) - 1)
        # windows do not cross texts
        first, last = np.maximum(first, starts[doc]), np.minimum(last, ends[doc] - length)
        ok = first <= last
        rows = []
        for d, p, before, after in zip(doc[ok].tolist(), (place - starts[doc])[ok].tolist(), (place - first)[ok].tolist(), (last + length - place)[ok].tolist()):
            t = texts[d]
            full = hashlib.blake2b(before.to_bytes(4) + t[p - before : p + after], digest_size=16).digest()
            r = _int64(hashlib.blake2b(b"r" + t[p : p + half], digest_size=8).digest()) if after >= half else None
            b = _int64(hashlib.blake2b(b"l" + t[p - half : p], digest_size=8).digest()) if before >= half else None
            rows.append((*keys[d], p, before, after, _int64(full), _int64(full[8:]), r, b))
        return rows

    def run(batches):
        names = ["_id", "_v", "pos", "before", "after", "c1", "c2", "k1", "k2"]

        def frame(keys, texts):
            # objects first: a missing key must not turn the others into floats
            return pd.DataFrame(of_slice(keys, texts), columns=names, dtype=object).astype({"_id": "Int64", "_v": "int64", "k1": "Int64", "k2": "Int64", "c1": "int64", "c2": "int64"} | {c: "int32" for c in ("pos", "before", "after")})

        for pdf in batches:
            keys, texts, size = [], [], 0
            for i, v, t in zip(pdf["_id"], pdf["_v"], pdf["_text"]):
                b = t.encode() if t else b""
                if len(b) < length:
                    continue
                if size + len(b) > SLICE and texts:
                    yield frame(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append((i, v))
                texts.append(b)
                size += len(b)
            if texts:
                yield frame(keys, texts)

    return run


def _cover_rows(length: int):
    def run(batches):
        for _, pdf in groups(batches, ["key", "_bi", "_bj"]):
            if len(pdf) < 2:
                continue
            cut, ctx = pdf["before"].tolist(), pdf["ctx"].tolist()
            left, right = covers([c[:b][::-1] for c, b in zip(ctx, cut)], [c[b:] for c, b in zip(ctx, cut)], length)
            on = (left > 0) | (right > 0)
            if on.any():
                yield pd.DataFrame({"c1": pdf["c1"].to_numpy()[on], "c2": pdf["c2"].to_numpy()[on], "cover_l": left[on].astype("int32"), "cover_r": right[on].astype("int32")})

    return run


def _contexts(batches):
    names = ["key", "_bi", "_bj", "c1", "c2", "before", "ctx"]
    for pdf in batches:
        rows = []
        for text, places in zip(pdf["_text"], pdf["places"]):
            b = text.encode()
            for x in places:
                rows.append((x["key"], x["_bi"], x["_bj"], x["c1"], x["c2"], x["before"], b[x["pos"] - x["before"] : x["pos"] + x["after"]]))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)


def _keep(batches):
    names = ["_id", "_v", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for pdf in batches:
        rows = []
        for i, v, t, spans in zip(pdf["_id"], pdf["_v"], pdf["_text"], pdf["spans"]):
            b = t.encode() if t else b""
            parts, at, removed = [], 0, 0
            for x in spans if spans is not None else ():
                parts.append(b[at : x["s"]])
                at = x["e"]
                removed += x["e"] - x["s"]
            kept = b"".join([*parts, b[at:]])
            rows.append((i, v, len(b), removed, len(parts), hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=names)
        out["_id"] = out["_id"].astype("Int64")
        yield out


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _v, spans): the disjoint byte spans (s, e) of rows (_id, _v, _text) that strings occurring elsewhere too cover."""
    kinds = "_id long, _v long, pos int, before int, after int, c1 long, c2 long, k1 long, k2 long"
    # _row names an anchor; it is fixed once written
    found = saved(rows.mapInPandas(_anchor_rows(length), kinds).withColumn("_row", F.monotonically_increasing_id()), "anchors")
    ctx = ["c1", "c2"]
    # anchors with equal surroundings cover all of them and have equal keys; one of each takes part in its groups
    same = {"before": F.max, "after": F.max, "k1": F.min, "k2": F.min, "_row": F.min}
    once = saved(found.groupBy(*ctx).agg(F.count("*").alias("n"), *[f(c).alias(c) for c, f in same.items()]), "surroundings")
    alike = once.where("n > 1").select(*ctx, F.col("before").alias("cover_l"), F.col("after").alias("cover_r"))
    keyed = once.select("_row", *ctx, F.explode(F.array_compact(F.array("k1", "k2"))).alias("key"))
    shared = saved(keyed.groupBy("key").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x <> y").select("key"), "shared-halves")
    chosen = saved(keyed.join(small(shared), "key"), "chosen")
    members = found.select("_row", "_id", "_v", "pos", "before", "after").join(small(chosen), "_row").drop("_row")
    paired = block_pairs(saved(members, "members"), ["key"], "c1", BLOCK_ROWS)
    places = paired.groupBy("_id", "_v").agg(F.collect_list(F.struct("key", "_bi", "_bj", "c1", "c2", "pos", "before", "after")).alias("places"))
    places = saved(places, "places")
    in_them = rows.join(small(places.select("_id", "_v")), ["_id", "_v"], "left_semi").dropDuplicates(["_id", "_v"])
    contexts = in_them.join(places, ["_id", "_v"]).mapInPandas(_contexts, "key long, _bi int, _bj int, c1 long, c2 long, before int, ctx binary")
    part = by_group(contexts, ["key", "_bi", "_bj"], _cover_rows(length), "c1 long, c2 long, cover_l int, cover_r int")
    cover = alike.unionByName(part).groupBy(*ctx).agg(F.max("cover_l").alias("cover_l"), F.max("cover_r").alias("cover_r"))
    spans = found.join(small(saved(cover, "covers")), ctx).select("_id", "_v", (F.col("pos") - F.col("cover_l")).alias("s"), (F.col("pos") + F.col("cover_r")).alias("e"))
    # the union of a document's spans, in order of their starts: one that starts beyond all ends so far opens a run
    w = Window.partitionBy("_id", "_v").orderBy("s", "e")
    ends = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("_opens", F.coalesce(F.col("s") > ends, F.lit(True)).cast("int")).withColumn("_run", F.sum("_opens").over(w))
    merged = runs.groupBy("_id", "_v", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy("_id", "_v").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _v (a hash of id and text, so that a repeated id is no mix-up), _text, and row: the row as one value, whose names cannot clash."""
    ident, text = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(ident.alias("_id"), F.xxhash64(ident, text).alias("_v"), text.alias("_text"), F.struct("*").alias("row"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with the texts that remove_repeats leaves; a character cut in part goes whole, a null text that loses nothing stays null."""
    named = _named(docs, id_col, text_col)
    spans = saved(repeated_spans(named.select("_id", "_v", "_text"), length), "spans")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, all_spans):
            b, parts, at = t.encode(), [], 0
            for x in spans:
                parts.append(b[at : x["s"]])
                at = x["e"]
            out.append(b"".join([*parts, b[at:]]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    out = named.join(small(spans, 32 + 8 * F.size("spans")), ["_id", "_v"], "left")
    left = F.when(F.col("spans").isNotNull(), rest("_text", F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")))).otherwise(F.col("row")[text_col])
    return out.select(*[(left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with with_text also kept binary.

    Texts are UTF-8 bytes, null ones empty. A byte goes if it is covered by a string of length bytes
    that also starts anywhere else, in the same text too; strings are judged on the input and do not
    cross texts. Copies are all removed; texts under length bytes stay whole. A repeated row counts as
    another place. An empty table gives no rows; other columns are ignored.
    """
    rows = _named(docs, id_col, text_col).select("_id", "_v", "_text")
    spans = saved(repeated_spans(rows, length), "spans")
    out = rows.join(small(spans, 32 + 8 * F.size("spans")), ["_id", "_v"], "left").mapInPandas(_keep, "_id long, _v long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    ident = F.when(F.col("_id") != -(1 << 62), F.col("_id")).alias(id_col)
    return out.select(ident, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
