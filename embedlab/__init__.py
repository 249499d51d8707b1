"""Paired-embedding alignment and evaluation as PySpark DataFrame operators."""
