"""Rollout analytics on Spark: tables in, lazily planned DataFrames out."""
