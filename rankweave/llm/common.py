"""Helpers shared by the training-data operators: saved tables, checked broadcasts, components, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes; bounds the temporary arrays.
SLICE_BYTES = 2 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary one if the executors are this process (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[context.applicationId]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: Column | int = 64, max_bytes: int = 64 << 20) -> DataFrame:
    """df (a saved table) with a broadcast hint if its rows, of row_bytes each, come to at most max_bytes; else df: Spark then shuffles."""
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes else df


def text_slices(ids, texts, limit: int = SLICE_BYTES):
    """Consecutive (ids, texts as bytes) of at most about limit bytes; null texts are empty."""
    some, size, at = [], 0, []
    for i, t in zip(ids, texts):
        b = (t if isinstance(t, bytes) else t.encode()) if t else b""
        if some and size + len(b) > limit:
            yield at, some
            some, size, at = [], 0, []
        some.append(b)
        at.append(i)
        size += len(b)
    if some:
        yield at, some


# ---------------------------------------------------------------- hashes

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def words64(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as little-endian integers; padded must end in 8 spare bytes."""
    return np.ndarray((len(padded) - 8,), dtype="<u8", buffer=padded, strides=(1,))


def slice_hashes(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice padded[start : start + size], eight bytes at a time."""
    eight = words64(padded)
    h = mix(size.astype(np.uint64) * _C1 + np.uint64(1))
    left, at, todo = size.copy(), start.copy(), np.arange(len(size))
    while len(todo):
        w = eight[np.minimum(at, len(eight) - 1)] & _MASKS[np.minimum(left, 8)]
        h[todo] = mix((h[todo] ^ w) + _C1)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts after lower-casing A-Z: hashes, places, and the text of each."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.zeros(len(joined) + 8, dtype=np.uint8)
        body = np.frombuffer(joined, dtype=np.uint8)
        raw[: len(body)] = _LOWER[body] if lower else body
        space = _SPACE[body]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.raw, self.start = raw, edge[0::2]
        self.end = edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.hash = slice_hashes(raw, self.start, self.end - self.start)
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count


def shingles(w: Words, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, as (text, hash) sorted; a text of fewer words has one shingle."""
    h, n = w.hash, len(w.hash)
    out_h, out_d = [], []
    if n >= k:
        s = mix(h[: n - k + 1] + _C1)
        for j in range(1, k):
            s = mix(s * _C1 + h[j : n - k + 1 + j])
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        out_h.append(s[ok])
        out_d.append(w.doc[: n - k + 1][ok])
    for c in range(1, k):
        few = np.flatnonzero(w.count == c)
        if len(few):
            at = w.first[few]
            s = mix(h[at] + _C2 * np.full(1, c + 7, dtype=np.uint64))
            for j in range(1, c):
                s = mix(s * _C1 + h[at + j])
            out_h.append(s)
            out_d.append(few)
    if not out_h:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    sh, sd = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((sh, sd))
    sh, sd = sh[order], sd[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    return sd[new], sh[new]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of start[i] .. start[i] + size[i] - 1 for every i, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(size) - size
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, size)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per node, component the smallest id.

    Every node hooks to its smallest neighbour, trees are flattened by pointer jumping, edges are
    contracted to the roots; rounds repeat until no edge is left. Nothing is collected; each round at
    least halves the nodes that still have edges.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select("a", "b")
    e = saved(e.unionByName(e.selectExpr("b as a", "a as b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        p = saved(e.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), f"{name}-hook")
        while True:
            q = p.selectExpr("a as p", "p as g")
            jumped = saved(p.select("a", "p").join(q, "p").selectExpr("a", "g as p", "g <> p as moved"), f"{name}-jump")
            forget(p)
            p = jumped
            if p.where("moved").isEmpty():
                break
        maps.append(p)
        of = p.select("a", "p")
        e_next = e.join(of, "a").join(of.selectExpr("a as b", "p as pb"), "b").where("p <> pb").selectExpr("p as a", "pb as b").distinct()
        e_next = saved(e_next, f"{name}-edges")
        forget(e)
        e = e_next
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[0].selectExpr("a as id", "p as component")
    for p in maps[1:]:
        step = p.selectExpr("a as component", "p as further")
        out = out.join(step, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    out = saved(out, name)
    forget(e, *maps)
    return out


# ---------------------------------------------------------------- groups that stream through a task


def groups(batches, key: list[str]):
    """Consecutive rows of equal key, as frames, from batches that are sorted by key; a group may span batches."""
    held, held_key = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cut], [*cut, len(pdf)]):
            this = tuple(k[s])
            if held and this != held_key:
                yield held_key, _joined(held)
                held = []
            held.append(pdf.iloc[s:e])
            held_key = this
    if held:
        yield held_key, _joined(held)


def _joined(frames):
    import pandas as pd

    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def by_group(df: DataFrame, key: list[str], run, schema: str) -> DataFrame:
    """run(batches) over df dealt out and sorted by key; groups() finds the groups inside."""
    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def block_pairs(df: DataFrame, group: list[str], row_hash: str, rows_a_block: int, own: bool = False) -> DataFrame:
    """df (a saved table) with its large groups dealt into blocks and rows copied to every pair of blocks, as columns _bi, _bj; with own, also a row's own block, _b.

    A group of at most rows_a_block rows is the one pair (0, 0). A task then holds two blocks at most,
    however large the group; every two rows of a group meet in some pair. Only the large groups, of which
    there are at most one for rows_a_block rows, are looked up, so that no group is sent to one task for it.
    """
    large = df.groupBy(*group).agg(F.ceil(F.count("*") / rows_a_block).cast("int").alias("_blocks")).where("_blocks > 1")
    out = df.join(small(saved(large, "large-groups")), group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    out = out.withColumn("_b", F.pmod(F.hash(row_hash), "_blocks")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_o", "_blocks", *([] if own else ["_b"]))
