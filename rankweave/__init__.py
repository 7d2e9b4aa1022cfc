"""Ranking, valuation and back-test operators over Spark DataFrames."""
