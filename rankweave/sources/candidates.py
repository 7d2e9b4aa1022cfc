"""Weight vectors to compare: the built-in ones, and those of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("valuation", "health", "quality", "shareholder_return", "growth", "momentum")
#: The built-in vectors by category, in the order above.
BUILT_IN = {
    "default": (0.50, 0.20, 0.10, 0.10, 0.10, 0.0),
    "value-tilted-defensive-legacy": (0.35, 0.25, 0.15, 0.15, 0.10, 0.0),
    "equal-weight": (0.20, 0.20, 0.20, 0.20, 0.20, 0.0),
    "quality-tilt": (0.30, 0.20, 0.30, 0.10, 0.10, 0.0),
    "momentum-on": (0.40, 0.20, 0.10, 0.10, 0.10, 0.10),
    "value-deep-evtilt": (0.50, 0.20, 0.10, 0.10, 0.10, 0.0),
    "value-deep-no-declining-fundamentals": (0.50, 0.20, 0.10, 0.10, 0.10, 0.0),
}
#: Weights of factors within a category, and directions of fundamentals that a vector leaves out.
SUB_WEIGHTS = {("value-deep-evtilt", "valuation"): {"ev_to_ebitda": 0.6, "price_to_fcf": 0.2, "pe_ratio": 0.1, "price_to_book": 0.1}}
EXCLUDED = {"value-deep-no-declining-fundamentals": ["declining"]}

FILE = "name string, weights map<string, double>, subFactorWeights map<string, map<string, double>>, filter struct<excludeFundamentalsDirections: array<string>>"


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, sub_weights, excluded): candidate, category, w; candidate, category, factor, w; candidate, direction."""
    rows = [(n, c, w) for n, ws in BUILT_IN.items() for c, w in zip(CATEGORIES, ws)]
    subs = [(n, c, f, w) for (n, c), fs in SUB_WEIGHTS.items() for f, w in fs.items()]
    out = [(n, d) for n, ds in EXCLUDED.items() for d in ds]
    return (
        spark.createDataFrame(rows, "candidate string, category string, w double"),
        spark.createDataFrame(subs, "candidate string, category string, factor string, w double"),
        spark.createDataFrame(out, "candidate string, direction string"),
    )


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three tables from a JSON array of vectors; names in camel case become snake case."""
    snake = lambda c: F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))
    docs = spark.read.schema(FILE).option("multiLine", True).json(path)
    weights = docs.select(F.col("name").alias("candidate"), F.explode("weights").alias("k", "w")).select("candidate", snake("k").alias("category"), "w")
    subs = docs.select(F.col("name").alias("candidate"), F.explode("subFactorWeights").alias("k", "fs")).select("candidate", snake("k").alias("category"), F.explode("fs").alias("f", "w"))
    out = docs.select(F.col("name").alias("candidate"), F.explode("filter.excludeFundamentalsDirections").alias("direction"))
    return weights, subs.select("candidate", "category", snake("f").alias("factor"), "w"), out
