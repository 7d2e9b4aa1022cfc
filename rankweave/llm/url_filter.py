"""URL rules indexed by their rarest literal token; a URL's tokens fetch the rules whose regular expressions run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Bytes of rules up to which they are broadcast; beyond, they are joined by shuffles.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for none."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' for none."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """The distinct runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))


def with_patterns(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) plus rule (their text), pattern (over 'host#path') and the literal tokens a match must hold.

    Neither side of a URL can hold the '#' between them; a rule that holds one fits nothing.
    The path is a prefix, so its last token may be the start of a longer one and is no literal unless
    another character follows it.
    """
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    host, path = F.coalesce(F.col("host"), F.lit("")), F.coalesce(F.col("path"), F.lit(""))
    literal = F.regexp_replace(F.concat(host, F.lit("#"), path), rf"{TOKEN}$", "")
    literal = F.when(path == "", F.concat(host, F.lit("#"))).otherwise(literal)
    return rules.select(F.concat(host, path).alias("rule"), F.col("verdict").alias("_rule_verdict"), F.concat(F.when(host == "", F.lit("^[^#]*")).otherwise(F.concat(F.lit(r"^(?:[^#]*\.)?"), quoted(host))), F.lit("#"), quoted(path)).alias("_pattern"), tokens_of(literal).alias("_literals"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule (the longest that fits, else null), verdict (its, else default).

    A rule fits its host and all subdomains (an empty one every host) where the path starts with the rule's. How often every
    rule token occurs is counted over all URLs, each rule is filed under its rarest token, and a URL's
    tokens fetch candidates by a join; rules without any literal are candidates of every URL. Equal
    rules: block beats allow. Null URLs and those without '://' have host '' and path ''. Repeated rows
    and null ids keep their number of rows; other columns are ignored; an empty table gives no rows.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")).groupBy("_id", "host", "path").agg(F.count("*").alias("_rows"))
    told = F.concat("host", F.lit("#"), "path")
    ruled = with_patterns(rules).groupBy("rule", "_pattern", "_literals").agg(F.max(F.struct(F.col("_rule_verdict") == "block", "_rule_verdict"))["_rule_verdict"].alias("_rule_verdict"))
    # tables of one short row for each rule, or for each literal token of one
    told_bytes = ruled.agg(F.sum(F.length("_pattern") + 16 * F.size("_literals") + 64)).first()[0] or 0
    hint = F.broadcast if told_bytes <= BROADCAST_BYTES else lambda d: d
    wanted = ruled.select(F.explode("_literals").alias("_token")).distinct()
    seen = base.select(F.explode(tokens_of(told)).alias("_token")).join(hint(wanted), "_token").groupBy("_token").count()
    counted = ruled.select("rule", "_pattern", "_rule_verdict", F.explode_outer("_literals").alias("_token")).join(hint(seen), "_token", "left")
    index = counted.groupBy("rule", "_pattern", "_rule_verdict").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), F.coalesce("_token", F.lit(""))))["col2"].alias("_token"))
    # '' files the rules that have no literal; every URL asks for it
    asked = base.select("_id", "host", "path", F.explode(F.array_union(tokens_of(told), F.array(F.lit("")))).alias("_token"))
    fits = asked.join(hint(index), "_token").where(F.expr("concat(host, '#', path) rlike _pattern"))
    best = fits.groupBy("_id", "host", "path").agg(F.max(F.struct(F.length("rule"), F.col("_rule_verdict") == "block", "rule", "_rule_verdict")).alias("_best"))
    on = [F.col("b._id").eqNullSafe(F.col("f._id")), F.col("b.host") == F.col("f.host"), F.col("b.path") == F.col("f.path")]
    out = base.alias("b").join(best.alias("f"), on, "left")
    out = out.select("b._id", "b.host", "b.path", "_rows", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best._rule_verdict"), F.lit(default)).alias("verdict"))
    each = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return each.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")
