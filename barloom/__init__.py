"""Spark jobs for panels of daily price bars: cleaning, risk, factors, evaluation, back-tests."""
