"""Cohort analytics on Spark: DataFrame-in, DataFrame-out operators for
observational studies on clinical event tables."""
