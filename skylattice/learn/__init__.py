"""Regressors, cross-validation, importance and search on pyspark.ml."""
