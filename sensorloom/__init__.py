"""Condition analytics on Spark: context assembly, features, rebalancing, sequences,
splits, drift, scoring, evaluation and data-quality profiling as DataFrame functions."""
