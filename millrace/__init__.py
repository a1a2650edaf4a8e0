"""Millrace: DataFrame-first analytics, resampling statistics and corpus preparation on Spark."""
