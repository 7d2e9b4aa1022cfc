"""Ranked lexical search: an Aho-Corasick automaton of all query terms runs over the documents' texts; there is no index.

Terms are guarded by a blank on both sides, and so are the words of a text, so that only whole words match. The automaton's
outputs are term numbers, which map to the items that ask for the term. One scan counts in how many documents each
term occurs, a second scores every document for every item and keeps each task's best; only those are sent on.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved, text_slices

#: Terms of items that are scanned for at once, in bytes: what is broadcast. More items are done block by block.
BLOCK_BYTES = 4 << 20
#: What an item counts besides its terms, for the candidates held for it.
ITEM_BYTES = 4096
#: Scores in memory at once: documents times items.
CELLS = 1 << 21
#: Candidates a task holds before it drops those that cannot be among the best.
MAX_HELD = 1 << 17
#: Parts of an item's candidates that are ranked apart first.
RANK_PARTS = 64

#: Bytes that part terms become a blank, A-Z lower case; what is not ASCII belongs to terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _lower(text: bytes) -> bytes:
    return text.translate(_TABLE)


def _terms_of(batches):
    for batch in batches:
        terms = [sorted({w.decode() for w in _lower((t or "").encode()).split()}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(terms, pa.list_(pa.string()))], names=["_item", "terms"])


def automaton(terms: list[str]):
    """The boundary-guarded automaton of terms; its outputs are their places in the list."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        # bytes as Latin-1 characters: one byte each in text, and no decoding
        a.add_word(f" {t.encode().decode('latin-1')} ", k)
    if terms:
        a.make_automaton()
    return a


_AUTOMATA: dict[str, object] = {}


def _own(block):
    """The automaton of a broadcast block, built once a worker."""
    key = block.value["key"]
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = automaton(block.value["terms"])
    return _AUTOMATA[key]


def _scan(a, texts: list[bytes]):
    """Per text: its number of terms with repeats, and how often each term of the automaton occurs."""
    for t in texts:
        words = _lower(t).split()
        n = len(words)
        yield n, Counter(k for _, k in a.iter(f" {b' '.join(words).decode('latin-1')} ")) if n and len(a) else {}


def _statistics(block):
    """First scan: rows (term, documents that hold it), and (-1, documents with terms), (-2, terms of all documents)."""

    def run(batches):
        a, df, n_docs, n_terms = _own(block), Counter(), 0, 0
        for batch in batches:
            for n, tf in _scan(a, [(t or "").encode() for t in batch.column("text").to_pylist()]):
                n_docs += n > 0
                n_terms += n
                df.update(tf.keys())
        df[-1], df[-2] = n_docs, n_terms
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], names=["term", "c"])

    return run


def _best(block, weights, n_docs: int, n_terms: int, top: int):
    """Second scan: each task's best documents of every item."""

    def run(batches):
        a, w = _own(block), weights.value
        at, of = block.value["at"], block.value["of"]  # items of term k: of[at[k] : at[k + 1]]
        items = block.value["items"]
        held = None
        rows = max(1, CELLS // max(items, 1))
        for batch in batches:
            ids = batch.column("_id")
            none, doc = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
            texts = batch.column("text").to_pylist()
            for which, some in text_slices(range(len(texts)), texts):
                for s in range(0, len(some), rows):
                    cells = np.zeros((min(rows, len(some) - s), items), dtype=np.int64)
                    for row, (n, tf) in zip(cells, _scan(a, some[s : s + rows])):
                        if not tf:
                            continue
                        k, c = np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                        m = 50 + (50 * n * n_docs) // n_terms
                        gain = w[k] * ((1_000_000_000 * c) // (1000 * c + 20 * m))
                        size = at[k + 1] - at[k]
                        first = np.cumsum(size) - size
                        into = of[np.arange(size.sum()) - np.repeat(first - at[k], size)]
                        np.add.at(row, into, np.repeat(gain, size))
                    mine = np.array(which[s : s + rows])
                    held = _kept(held, cells, none[mine], doc[mine], top)
        if held is not None:
            item, score, none, doc = _pruned(held, top)[:4]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=none)], names=["_item", "score", "_id"])

    return run


def _pruned(held, top: int):
    """Of the candidates (item, score, none, doc) each item's best, and the scores that further ones must reach."""
    item, score, none, doc, least = held
    order = np.lexsort((doc, none, -score, item))
    sorted_item = item[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
    keep, last = order[place < top], order[place == top - 1]
    least = least.copy()
    least[item[last]] = score[last]
    return item[keep], score[keep], none[keep], doc[keep], least


def _kept(held, cells: np.ndarray, none: np.ndarray, doc: np.ndarray, top: int):
    """held and the documents of cells (documents by items) that can still be among the best; ties are decided by id."""
    if held is None:
        held = (*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64)), np.ones(cells.shape[1], dtype=np.int64))
    d, i = np.nonzero(cells >= held[4])
    held = (*(np.concatenate(x) for x in zip(held[:4], (i, cells[d, i], none[d], doc[d]))), held[4])
    return _pruned(held, top) if len(held[0]) > MAX_HELD + top * cells.shape[1] else held


def _blocks(items: DataFrame, block_bytes: int):
    """Items (_item, terms) in blocks, each collected by itself: at most block_bytes, of terms and ITEM_BYTES an item, or one item alone."""
    size = F.aggregate("terms", F.lit(ITEM_BYTES).cast("long"), lambda a, t: a + F.octet_length(t) + 8)
    sized = items.select("_item", "terms", size.alias("_size"))
    total, count = sized.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    n = max(1, min(count, math.ceil(2 * total / block_bytes))) if total > block_bytes else 1
    while True:
        block = F.pmod(F.xxhash64("_item", F.lit(n)), F.lit(n))
        blocks = sized.groupBy(block.alias("b")).agg(F.sum("_size").alias("s"), F.count("*").alias("c")).collect()  # a row a block
        if all(r.s <= block_bytes or r.c == 1 for r in blocks):
            break
        n *= 2
    for r in blocks:
        yield sized.where(block == r.b).select("_item", "terms").collect()


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best documents of every item: item_id, rank (from 1), doc_id, score, highest first, equal scores by ascending doc_id.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII. N counts the documents with a term, L
    all their terms, n those of a document, df the documents that hold a term, tf how often. score sums over an item's distinct terms
    floor(1000 ln((2N + 2) / (2df + 1))) * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L; only scores above 0 count.

    Null texts have no terms. Every row is a document of its own, so that repeated rows take a rank each; null ids come last among
    equal scores. Rows that repeat an item's id are one item with the terms of all; a null item is one item. Items without
    terms, and empty tables, give no rows. Columns beyond those named are ignored. Items are taken in blocks of bounded size; an item's
    own terms must fit in a worker's memory.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    pairs = items.select(F.col(item_col).cast("long").alias("_item"), F.col(query_col).alias("text")).mapInArrow(_terms_of, "_item long, terms array<string>")
    asked = saved(pairs.select("_item", F.explode("terms").alias("t")).groupBy("_item").agg(F.array_sort(F.collect_set("t")).alias("terms")), "item-terms")
    out, passing = None, []
    for rows in _blocks(asked, block_bytes):
        terms = sorted({t for r in rows for t in r.terms})
        number = {t: k for k, t in enumerate(terms)}
        asks = np.array(sorted((number[t], i) for i, r in enumerate(rows) for t in r.terms), dtype=np.int64)
        at = np.searchsorted(asks[:, 0], np.arange(len(terms) + 1))
        # an item is its place in the block, as its id may be null
        block = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "terms": terms, "at": at, "of": asks[:, 1].copy(), "items": len(rows)})
        found = dict(texts.mapInArrow(_statistics(block), "term long, c long").groupBy("term").agg(F.sum("c")).collect())  # a row a term of the block
        n_docs, n_terms = found.get(-1, 0), found.get(-2, 0)
        if n_terms:
            weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(k, 0) + 1))) for k in range(len(terms))], dtype=np.int64))
            best = texts.mapInArrow(_best(block, weights, n_docs, n_terms, top), "_item long, score long, _id long")
            names = spark.createDataFrame([(i, r._item) for i, r in enumerate(rows)], "_item long, _own long")
            order = [F.desc("score"), F.asc_nulls_last("_id")]
            # tasks' best meet in parts first, so that no task gathers those of all tasks
            half = best.withColumn("_part", F.spark_partition_id() % RANK_PARTS).withColumn("_place", F.row_number().over(Window.partitionBy("_item", "_part").orderBy(*order))).where(F.col("_place") <= top)
            ranked = half.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= top)
            done = saved(ranked.join(F.broadcast(names), "_item").select(F.col("_own").cast(kind).alias(item_col), "rank", F.col("_id").alias(id_col), "score"), "best")
            out = done if out is None else out.unionByName(done)
            passing.append(weights)
        passing.append(block)
    for b in passing:
        b.destroy()
    forget(asked)
    return out if out is not None else spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
