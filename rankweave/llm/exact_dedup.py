"""Exact dedup by composable polynomial fingerprints, proved by chunkwise comparison.

A text's fingerprint is its bytes as the coefficients of a polynomial, evaluated modulo two primes.
Chunks are hashed side by side and combined by H(xy) = H(x) * B^|y| + H(y), so that a huge document
can be hashed in parts that meet in any order-preserving grouping. Texts of equal length and
fingerprint are then compared with the group's representative, chunk by chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
#: Bytes hashed as one unit; 39 bits a product times 2**14 terms stays inside 64 bits.
CHUNK = 1 << 14
#: Characters compared at once.
COMPARE_CHARS = 1 << 16
#: Rows of a group that are compared with one copy of its representative.
ROWS_A_COPY = 512

_POWERS = []
for _b, _p in zip(BASES, PRIMES):
    _x = [1]
    for _ in range(CHUNK - 1):
        _x.append(_x[-1] * _b % _p)
    _POWERS.append(np.array(_x[::-1], dtype=np.uint64))


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """Fingerprint of the concatenation, from those of its parts."""
    return tuple((h * pow(b, right_bytes, p) + g) % p for h, g, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both residues of data: full chunks hashed side by side as rows of a matrix, then combined in order."""
    body = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    full = len(body) // CHUNK
    out = (0, 0)
    if full:
        rows = body[: full * CHUNK].reshape(full, CHUNK)
        each = [(rows @ w) % np.uint64(p) for w, p in zip(_POWERS, PRIMES)]
        for h in zip(*each):
            out = combine(out, (int(h[0]), int(h[1])), CHUNK)
    rest = body[full * CHUNK :]
    if len(rest):
        out = combine(out, tuple(int((rest * w[CHUNK - len(rest) :]).sum() % np.uint64(p)) for w, p in zip(_POWERS, PRIMES)), len(rest))
    return out


def _fingerprints(batches):
    """Per row: id, n_bytes, fingerprint and digest, and the text itself where the schema asks for it."""
    for pdf in batches:
        n, fp, sha = [], [], []
        for t in pdf["_text"]:
            b = t.encode() if t else b""
            x, y = fingerprint(b)
            n.append(len(b))
            fp.append(x << 31 | y)
            sha.append(hashlib.sha256(b).hexdigest())
        yield pd.DataFrame({"_id": pdf["_id"], "n_bytes": n, "fp": fp, "text_sha256": sha, "_text": pdf["_text"]})


def _without_texts(batches):
    for pdf in _fingerprints(batches):
        yield pdf.drop(columns="_text")


def _chunks(df: DataFrame) -> DataFrame:
    size = F.lit(COMPARE_CHARS)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("_text") / size) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.col("_text"), i * size + 1, size))
    return df.select(*[c for c in df.columns if c != "_text"], F.posexplode(parts).alias("_k", "_part"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, keep_id (largest id of its equal texts), group_size, kept, text_sha256.

    A null text counts as empty, and empty texts equal one another. Rows that repeat an id and a text
    are one group; one of them is kept. An id that comes with several texts takes part with each. Rows
    with a null id take part, and are kept only if all ids of the group are null. An empty table gives
    no rows. Columns of docs beyond the two named are ignored.

    A group of any size is spread: its rows are compared with copies of its representative, one for
    every ROWS_A_COPY of them, and what is told of the group comes back by a join alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = "_id long, n_bytes long, fp long, text_sha256 string"
    # _row tells rows that repeat an id and a text apart; it is fixed once written
    fps = saved(rows.mapInPandas(_without_texts, kinds).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    key, same = ["n_bytes", "fp"], ["_id", "n_bytes", "fp", "text_sha256"]
    copies = F.ceil(F.count("*") / ROWS_A_COPY).cast("int").alias("_copies")
    groups = saved(fps.groupBy(*key).agg(F.max(F.struct("_id", "text_sha256")).alias("_rep"), F.count("*").alias("_n"), copies).where("_n > 1").drop("_n"), "equal-fingerprints")
    # of equal fingerprints, the texts: an id names the rows to read again, the fingerprint those that count
    ids = saved(fps.join(small(groups), key, "left_semi").select(F.col("_id").alias("_own")).distinct(), "members")
    read = rows.join(small(ids), F.col("_id").eqNullSafe(F.col("_own")), "left_semi").mapInPandas(_fingerprints, kinds + ", _text string")
    texts = read.join(small(groups), key)
    is_rep = F.col("_id").eqNullSafe(F.col("_rep._id")) & (F.col("text_sha256") == F.col("_rep.text_sha256"))
    mine = _chunks(texts.where(~is_rep).select(*same, "_text", F.pmod(F.xxhash64("_id", "text_sha256"), "_copies").alias("_copy")))
    first = texts.where(is_rep).groupBy(*key, "_copies").agg(F.first("_text").alias("_text"))
    reps = _chunks(first.select(*key, "_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies").cast("long") - 1)).alias("_copy"))).withColumnRenamed("_part", "_its")
    unequal = mine.join(reps, [*key, "_copy", "_k"], "left").where("not (_part <=> _its)").select(*[F.col(c).alias(f"u_{c}") for c in same]).distinct()
    # a text that differs from the representative of its fingerprint forms a class with its own digest
    odd = F.col("_id").eqNullSafe(F.col("u__id")) & (F.col("n_bytes") == F.col("u_n_bytes")) & (F.col("fp") == F.col("u_fp")) & (F.col("text_sha256") == F.col("u_text_sha256"))
    told = fps.join(small(saved(unequal, "unequal")), odd, "left").select(*same, "_row", F.when(F.col("u_fp").isNotNull(), F.col("text_sha256")).otherwise("").alias("_class"))
    # only groups are looked up, by a join that Spark may split where a group is hot: nothing is sorted or counted after it
    stays = told.groupBy(*key, "_class").agg(F.max(F.struct("_id", "_row")).alias("_stays"), F.count("*").alias("_n")).where("_n > 1")
    out = told.join(small(saved(stays, "classes")), [*key, "_class"], "left")
    alone = F.col("_stays").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_stays._id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_stays._row"))).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_groups does not keep; of rows that repeat an id and a text one stays."""
    told = saved(exact_groups(docs, id_col, text_col), "exact-groups")
    mark = told.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    marked = saved(mark.where("not _kept or _rows > 1"), "copies")
    # the row as one value, so that its columns' names cannot clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_own"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_digest"))
    on = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    out = rows.join(small(marked.where("not _kept")), on, "left_anti")
    again = marked.where("_kept")
    if not again.isEmpty():
        once = out.join(small(again), on, "left_semi").groupBy("_own", "_digest").agg(F.first("row").alias("row")).select("row", "_own", "_digest")
        out = out.join(small(again), on, "left_anti").unionByName(once)
    return out.select("row.*")
