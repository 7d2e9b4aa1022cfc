"""Nearest neighbours through learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts with few edges across; a
small classifier learns which parts hold a vector's neighbours. It files every row under its likeliest
part, and sends a query to several of the likeliest, where all rows are compared exactly. How many is
settled on sampled vectors kept from training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bound on the vectors that the index is fitted on, those of smallest hash of their id.
MAX_FIT = 4096
#: Rows that a part is meant for, and the bound on the number of parts.
PART_ROWS, MAX_PARTS = 1600, 128
#: A few parts even for few rows, if each can have this many.
LEAST_PARTS, LEAST_ROWS = 8, 60
NEIGHBOURS, HIDDEN, EPOCHS, SEED = 10, 96, 40, 3
#: Share of sampled true neighbours that the probed parts must hold.
TARGET = 0.96
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: exact, and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit row, by blocks."""
    out = []
    for s in range(0, len(x), 256):
        sim = x[s : s + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out.append(np.argpartition(-sim, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of every node of the graph: regions grown to equal sizes, then moves to the part of most neighbours within 5 % of balance."""
    n = len(near)
    links: list[list[int]] = [list(r) for r in near]
    for i, r in enumerate(near):
        for j in r:
            links[j].append(i)
    part = np.full(n, -1)
    rng = np.random.default_rng(SEED)
    room = [n // parts + (p < n % parts) for p in range(parts)]
    free = list(rng.permutation(n)[::-1])
    for p in range(parts):
        gain: dict[int, int] = {}
        for _ in range(room[p]):
            # the free node with most links into the region, else a new seed
            at = max(gain, key=gain.get) if gain else None
            if at is None:
                while part[free[-1]] >= 0:
                    free.pop()
                at = free.pop()
            gain.pop(at, None)
            part[at] = p
            for j in links[at]:
                if part[j] < 0:
                    gain[j] = gain.get(j, 0) + 1
    size, most = np.bincount(part, minlength=parts), int(np.ceil(1.05 * n / parts))
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            count = np.bincount(part[links[i]], minlength=parts)
            best = int(np.argmax(np.where(size < most, count, -1)))
            if count[best] > count[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """Probabilities of the parts for unit vectors, and how many of them a query probes."""

    layers: tuple
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.tanh(x @ w1 + b1) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def learn(x: np.ndarray, parts: int, k: int) -> Router:
    """The router of sampled vectors x: a network that is taught the share of each part among a vector's neighbours."""
    x = unit(np.unique(x, axis=0).astype(np.float64))
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        d = x.shape[1]
        return Router((np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    near = neighbours(x.astype(np.float32), min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    target[np.arange(len(x)), part] += near.shape[1] / 2
    target /= target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 8], order[len(x) // 8 :]
    scale = np.sqrt(x.shape[1])  # unit vectors have small components
    p = [rng.normal(0, 1, (x.shape[1], HIDDEN)) * scale / x.shape[1] ** 0.5, np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(x[at] @ p[0] + p[1])
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            e = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            back = (e @ p[2].T) * (1 - h**2)
            t += 1
            for i, g in enumerate([x[at].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(tuple(p), parts)
    # rank of the part that each true neighbour of a held vector is filed under
    home = router.probabilities(x).argmax(axis=1)
    rank = np.argsort(np.argsort(-router.probabilities(x[held]), axis=1), axis=1)
    nearest = neighbours(x, min(k, len(x) - 1))[held]
    need = np.sort(np.take_along_axis(rank, home[nearest], axis=1).ravel())
    router.probes = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1
    return router


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row by cosine in double precision, from 1, ties to the smaller id.

    Queries are the rows where is_query holds; every row but the query's own is a candidate. Vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do null ids; of rows that repeat an id the least vector counts. Fewer candidates than k
    give fewer rows, an empty table none; other columns are ignored. Parts are filed and queried in
    blocks, so a part of any size, such as one of many equal vectors, is spread over tasks.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = F.col("_id").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where(fine)
    rows = saved(rows.groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_q").alias("_q")), "vectors")
    shape = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dims, total = shape
    rows = rows.where(F.size("_v") == dims)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("_id"), "_id").limit(MAX_FIT).select("_v").collect()])
    router = spark.sparkContext.broadcast(learn(sample, min(MAX_PARTS, max(total // PART_ROWS, min(LEAST_PARTS, total // LEAST_ROWS))), k))

    def route(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            prob = router.value.probabilities(unit(np.stack(pdf["_v"])))
            order = np.argsort(-prob, axis=1, kind="stable")[:, : router.value.probes]
            yield pd.DataFrame({"_id": pdf["_id"], "_v": pdf["_v"], "_q": pdf["_q"], "part": order[:, 0], "probed": list(order)})

    filed = saved(rows.mapInPandas(route, "_id long, _v array<double>, _q boolean, part int, probed array<int>"), "filed")
    blocks = lambda df, n, name: df.groupBy("part").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    asked = filed.where("_q").select("_id", "_v", F.explode("probed").alias("part"))
    size = F.broadcast(blocks(filed, CANDIDATE_BLOCK, "c").join(blocks(asked, QUERY_BLOCK, "q"), "part"))  # at most MAX_PARTS rows
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spot = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
    cand = filed.join(size, "part").select(F.col("part").alias("p"), spot("c").alias("c_b"), upto("q").alias("q_b"), F.col("_id").alias("vec_id"), F.col("_v").alias("vec"))
    query = asked.join(size, "part").select("part", upto("c").alias("cb"), spot("q").alias("qb"), "_id", "_v")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        qv, cv, ids = scaled(np.stack(q["_v"])), scaled(np.stack(c["vec"])), c["vec_id"].to_numpy()
        qn, cn = np.sqrt((qv**2).sum(axis=1)), np.sqrt((cv**2).sum(axis=1))
        rough = (qv @ cv.T) / qn[:, None] / cn
        out = []
        for i, own in enumerate(q["_id"]):
            sim = np.where(ids == own, -np.inf, rough[i])
            last = np.partition(sim, -k)[-k] if len(sim) > k else -np.inf
            at = np.flatnonzero((sim >= last - 1e-9) & (ids != own))
            exact = (cv[at] * qv[i]).sum(axis=1) / (cn[at] * qn[i])
            best = np.lexsort((ids[at], -exact))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out)

    key = ["part", "cb", "qb"]
    found = query.groupBy(*key).cogroup(cand.groupBy("p", "c_b", "q_b")).applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
