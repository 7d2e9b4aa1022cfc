"""Tables of HTML pages as grids of cells, spans resolved, and the log of index changes that such a table holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest spans, as browsers take them.
MAX_COLUMNS, MAX_ROWS = 1000, 65_534
#: Entities that are read, and what they stand for.
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&#39;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Text without tags, entities read, runs of white space as one blank."""
    text = F.regexp_replace(html, "<[^>]+>", "")
    for entity, stands in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(stands))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _span(attributes: Column, name: str, most: int) -> Column:
    found = F.regexp_extract(attributes, rf"""(?i)\b{name}\s*=\s*["']?\s*(\d{{1,9}})""", 1)
    n = F.when(found != "", found.cast("int"))
    # 0 reaches to the end of the table
    return F.when(n.isNull(), 1).when(n == 0, most).otherwise(F.least(n, F.lit(most)))


def cells_of(row: Column) -> Column:
    """The cells of a row's HTML as written: array of (text, wide, high)."""
    each = F.regexp_extract_all(row, F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)(?=<t[dh]\b|</tr|$)"), F.lit(1))
    tag = lambda x: F.regexp_extract(x, r"(?is)^<t[dh]\b([^>]*)>", 1)
    return F.transform(each, lambda x: F.struct(plain_text(F.regexp_replace(x, r"(?is)</t[dh]\s*>.*$", "")).alias("text"), _span(tag(x), "colspan", MAX_COLUMNS).alias("wide"), _span(tag(x), "rowspan", MAX_ROWS).alias("high")))


def _resolved(rows: Column) -> Column:
    """Rows of cells as written, to rows of (text, left): a cell fills all columns it spans, and the rows below for left more rows."""
    kind = "array<struct<text:string,left:int>>"

    def carried(above: Column, at: Column) -> Column:
        """The cells that reach down from the row above, from column `at` on without a gap."""
        tail = F.slice(above, at + 1, F.greatest(F.size(above), F.lit(1)))
        gap = F.array_position(F.transform(tail, lambda x: x["left"] > 0), False).cast("int")
        return F.transform(F.slice(tail, F.lit(1), F.when(gap == 0, F.size(tail)).otherwise(gap - 1)), lambda x: F.struct(x["text"].alias("text"), (x["left"] - 1).alias("left")))

    def placed(above: Column, row: Column) -> Column:
        put = lambda done, cell: F.concat(done, carried(above, F.size(done)), F.array_repeat(F.struct(cell["text"].alias("text"), (cell["high"] - 1).alias("left")), cell["wide"]))
        return F.aggregate(row, F.array().cast(kind), put, lambda done: F.concat(done, carried(above, F.size(done))))

    zero = F.struct(F.array().cast(f"array<{kind}>").alias("rows"), F.array().cast(kind).alias("last"))
    one = lambda a, row: F.get(F.transform(F.array(placed(a["last"], row)), lambda r: F.struct(F.array_append(a["rows"], r).alias("rows"), r.alias("last"))), F.lit(0))
    return F.transform(F.aggregate(rows, zero, one)["rows"], lambda row: F.transform(row, lambda x: x["text"]))


def table_grid(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", table_class: str = "") -> DataFrame:
    """One row per table row of a page: id, table and row (from 0), cells: the texts of its columns, with row and column spans filled in.

    table_class keeps tables whose class names hold it; table numbers count those only. Nested tables are not told apart. A page without tables, or null,
    gives no rows. Rows are put together only as far as spans reach: a long table is cut where no cell reaches down.
    """
    opening = rf"""<table\b[^>]*class\s*=\s*["'][^"']*{table_class}[^"']*["'][^>]*>""" if table_class else r"<table\b[^>]*>"
    bodies = F.regexp_extract_all(html_col, F.lit(rf"(?is){opening}(.*?)</table>"), F.lit(1))
    tables = pages.select(F.col(id_col).alias("_id"), F.posexplode(bodies).alias("table", "_t"))
    rows = tables.select("_id", "table", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr|<tr\b|$)"), F.lit(1))).alias("row", "_r"))
    rows = rows.select("_id", "table", "row", cells_of(F.col("_r")).alias("_cells"))
    reach = F.col("row") + F.coalesce(F.array_max(F.transform("_cells", lambda c: c["high"])), F.lit(1)) - 1
    w = Window.partitionBy("_id", "table").orderBy("row")
    before = F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("_new", (F.coalesce(before, F.lit(-1)) < F.col("row")).cast("int")).withColumn("_block", F.sum("_new").over(w))
    blocks = cut.groupBy("_id", "table", "_block").agg(F.min("row").alias("_first"), F.transform(F.array_sort(F.collect_list(F.struct("row", "_cells"))), lambda x: x["_cells"]).alias("_rows"))
    out = blocks.select("_id", "table", "_first", F.posexplode(_resolved(F.col("_rows"))).alias("_k", "cells"))
    return out.select(F.col("_id").alias(id_col), "table", (F.col("_first") + F.col("_k")).alias("row"), "cells")


def page_date(text: Column) -> Column:
    """A date written as 2024-03-17, March 17, 2024, Mar 17 2024 or 17 March 2024; null for anything else."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})$", 1)
    us = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    eu = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    # fixed values: months by number, whole or in short
    months = "january february march april may june july august september october november december".split()
    names = {n: k for k, m in enumerate(months, 1) for n in (m, m[:3])} | {"sept": 9}
    number = F.create_map(*[F.lit(x) for n, k in names.items() for x in (n, f"{k:02d}")])
    made = lambda y, m, d: F.concat_ws("-", y, F.try_element_at(number, F.lower(m)), F.lpad(d, 2, "0"))
    part = lambda p, k: F.regexp_extract(t, p, k)
    text_ = F.when(iso != "", iso).when(part(us, 1) != "", made(part(us, 3), part(us, 1), part(us, 2))).when(part(eu, 1) != "", made(part(eu, 3), part(eu, 2), part(eu, 1)))
    return F.try_to_date(F.when(F.length(text_) == 10, text_), "yyyy-MM-dd")


def index_changes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", table: int = 1, table_class: str = "wikitable") -> DataFrame:
    """(id, row, date, added, added_name, removed, removed_name, reason) of a page's table of changes: the `table`-th (from 0) of its class.

    Columns: date, ticker and name added, ticker and name removed, reason (may be missing). A row whose date cell is blank takes the date above it;
    rows of under five columns, or without a date, are no changes. Blank tickers and reasons are null.
    """
    grid = table_grid(pages, id_col, html_col, table_class).where((F.col("table") == table) & (F.size("cells") >= 5))
    w = Window.partitionBy(id_col).orderBy("row")
    cell = lambda k: F.trim(F.get("cells", F.lit(k)))
    filled = lambda k: F.when(cell(k) != "", cell(k))
    # a row that is no change, such as a heading, ends the dates above it
    told = F.when(cell(0) != "", F.struct(page_date(cell(0)).alias("date")))
    rows = grid.withColumn("date", F.last(told, True).over(w)["date"]).where("date is not null")
    named = lambda k: F.when(cell(k) != "", cell(k + 1))
    return rows.select(id_col, "row", "date", filled(1).alias("added"), named(1).alias("added_name"), filled(3).alias("removed"), named(3).alias("removed_name"), filled(5).alias("reason"))
