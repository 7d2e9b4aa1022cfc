"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every run of t words holds t - k + 1 k-grams; the smallest hash of each run is kept. A run that a document shares with an
item has the same smallest hash in both, so kept hashes that meet find every shared run. Around a document's hash
that meets an item's the at most t - k + 1 runs that hold it are written out and looked up word for word: that is exact.
A document's texts never leave their task; what is sent on are its number of words and the runs found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, small

#: Words of a k-gram; shorter runs than this are their own.
GRAM = 3
#: Bits that hold a word's place in a text; the others of 64 hold a hash, which only chooses what is looked at.
PLACE_BITS = 31
#: Longs of the bit map that sorts out most hashes no item has; its size is fixed, and what it lets through is joined all the same.
MAP_LONGS = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), ""), F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def winnowed(words: Column, t: int, k: int) -> Column:
    """The kept k-grams of every run of t words, as longs: PLACE_BITS of place under the top bits of the hash; empty for fewer than t words.

    Of equal hashes in a run any may be kept, since hashes are compared by value; at the end of a text some k-grams more are kept.
    """
    n, w = F.size(words), t - k + 1
    each = F.transform(words, lambda x: F.xxhash64(x))
    gram = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
    kept, span = let(each, gram), 1
    while span < w:  # the least of `span` neighbours, then of twice as many
        move = min(span, w - span)
        kept = let(kept, lambda h, move=move: F.zip_with(h, F.slice(h, move + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.least(x, y)))
        span += move
    return F.when(n >= t, F.array_distinct(kept)).otherwise(F.array().cast("array<bigint>"))


def place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def fingerprint(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def runs_of(words: Column, t: int) -> Column:
    """Every run of t words, as one string each."""
    n = F.size(words)
    return F.when(n >= t, F.transform(F.sequence(F.lit(0), n - t), lambda s: F.array_join(F.slice(words, s + 1, F.lit(t)), " "))).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, items: DataFrame, run: int = 10, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_hit (words inside a run of `run` consecutive words of an item), n_items (items with such runs),
    items_sha256 (of their ids, sorted as strings, comma-joined), contaminated (n_hit > 0).

    Words are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII. An item of fewer words, but not none, is
    one run. A null text has no words; repeated rows of docs, also of one id, are told apart and give a row each; rows
    that repeat an item's id are one item; a null item id counts as an item named "". An empty table of docs gives no rows, an
    empty table of items no hits. Other columns are ignored. A text of any length is worked on whole, in its row.

    Runs of any items collapse to the distinct ones, and items with the same runs to a set, so that a passage in many
    documents and items is looked up once a document.
    """
    named = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    of_items = items.select(named.alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).select("item", "words", F.least(F.size("words"), F.lit(run)).alias("t"))
    of_items = saved(of_items, "item-words")
    lengths = sorted(r.t for r in of_items.select("t").distinct().collect())  # at most `run` numbers
    grams = {t: min(gram, t) for t in lengths}
    prints, runs = None, None
    for t in lengths:
        here = of_items.where(F.col("t") == t)
        p = here.select(F.lit(t).alias("t"), F.explode(winnowed(F.col("words"), t, grams[t])).alias("x")).select("t", fingerprint(F.col("x")).alias("fp")).distinct()
        r = here.select("item", F.explode(runs_of(F.col("words"), t)).alias("run")).distinct()
        prints, runs = (p, r) if prints is None else (prints.unionByName(p), runs.unionByName(r))
    if not lengths:
        out = docs.select(F.col(id_col), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
        return out.select(id_col, "n_words", *[F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")], F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    prints = saved(prints, "item-prints")
    # the items of a run as one set; runs with the same items share it
    by_run = saved(runs.distinct().groupBy("run").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-runs")
    sets = saved(by_run.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "item-sets")
    runs_to_set = saved(by_run.join(sets, "items").select("run", "set"), "runs")

    # which hashes an item may have, as bits: at most MAP_LONGS rows
    spread = F.pmod("fp", F.lit(MAP_LONGS)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(fp, 10), 64) as int))")
    longs = dict(prints.groupBy(spread.alias("at")).agg(F.bit_or(bit)).collect())
    bits = F.expr("array(" + ", ".join(f"{longs.get(i, 0)}L" if longs.get(i, 0) > -(1 << 63) else "shiftleft(1L, 63)" for i in range(MAP_LONGS)) + ")")
    may = lambda x: F.getbit(F.get(bits, F.pmod(fingerprint(x), F.lit(MAP_LONGS)).cast("int")), F.pmod(F.shiftright(fingerprint(x), 10), F.lit(64)).cast("int")) == 1

    w = F.col("words")
    head = F.array(F.struct(F.lit(0).alias("t"), F.lit(-1).alias("p"), F.lit(None).cast("long").alias("fp"), F.lit("").alias("around")))

    def around(t: int):
        """Kept k-grams with the words of all runs that hold them."""
        first = lambda p: F.greatest(p - (t - grams[t]), F.lit(0))
        return F.transform(F.filter(winnowed(w, t, grams[t]), may), lambda x: F.struct(F.lit(t).alias("t"), place(x).alias("p"), fingerprint(x).alias("fp"), F.array_join(F.slice(w, first(place(x)) + 1, F.lit(2 * t - grams[t])), " ").alias("around")))

    # one row of a document stands for itself (p = -1), the others for kept k-grams; explode_outer works the array out once, explode would twice
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("words"))
    kept = texts.select("row", "_id", F.size(w).cast("long").alias("n_words"), F.explode_outer(F.concat(head, *map(around, lengths))).alias("x")).select("row", "_id", "n_words", "x.*")
    met = kept.join(small(prints).withColumn("met", F.lit(True)), ["t", "fp"], "left").where("met or p = -1")
    gram_of = F.element_at(F.create_map(*[F.lit(v) for t in [0, *lengths] for v in (t, grams.get(t, 0))]), F.col("t"))
    start = F.greatest(F.col("p") - (F.col("t") - gram_of), F.lit(0))
    near = F.split("around", " ")
    extended = F.transform(F.sequence(F.lit(0), F.size(near) - F.col("t")), lambda s: F.struct((start + s).alias("s"), F.array_join(F.slice(near, s + 1, F.col("t")), " ").alias("run")))
    own = F.array(F.struct(F.lit(-1).alias("s"), F.lit(None).cast("string").alias("run")))
    each = met.select("row", "_id", "n_words", "t", F.explode_outer(F.when(F.col("p") < 0, own).when(F.size(near) >= F.col("t"), extended)).alias("y")).select("row", "_id", "n_words", "t", "y.*")
    hit = each.join(small(runs_to_set, F.length("run") + 64), "run", "left").where("set is not null or s = -1")
    found = hit.groupBy("row", "_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("set").isNotNull(), F.struct("s", "t")))).alias("spans"), F.collect_set("set").alias("sets")
    )
    # words under spans, in order of their starts
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    under = F.aggregate("spans", zero, lambda a, x: F.struct((a["n"] + F.greatest(x["s"] + x["t"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["s"] + x["t"]).alias("end")))["n"]
    found = saved(found.select("row", "_id", "n_words", under.alias("n_hit"), "sets"), "contaminated")
    forget(of_items, prints, by_run, runs_to_set)
    pairs = found.where(F.size("sets") > 0).select("row", F.explode("sets").alias("set")).join(small(sets, F.aggregate("items", F.lit(64), lambda a, i: a + F.length(i) + 16)), "set")
    told = pairs.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = told.select("row", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = found.join(told, "row", "left")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
