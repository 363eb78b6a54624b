"""Estimators: statistics are gathered by Spark, only small matrices are solved on the driver."""
